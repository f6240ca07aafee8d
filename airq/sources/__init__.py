"""Where readings come from: CSV files, the test tables, the stored table."""
