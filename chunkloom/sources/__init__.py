"""Reading and writing of files, JSON lines and sources."""
