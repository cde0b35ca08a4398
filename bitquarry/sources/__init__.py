"""Reading and writing files of packed messages."""
