"""Where rows come from and go to: versioned Parquet tables, CSV files, rows in memory."""
