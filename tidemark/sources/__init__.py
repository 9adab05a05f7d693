"""Where rows come from and go to: landed files, and the library's own Parquet tables."""
