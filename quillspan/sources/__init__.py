"""Reading and writing the project's file formats."""
