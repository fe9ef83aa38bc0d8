"""Web-crawl analytics on Spark: DataFrame functions over a snapshot of fetched pages."""
