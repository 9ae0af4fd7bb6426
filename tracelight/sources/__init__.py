"""Reading and writing: delimited files, table files, printed tables, the model store."""
