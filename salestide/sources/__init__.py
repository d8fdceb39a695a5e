"""Where rows come from and go to: CSV exports, stored tables, Parquet views."""
