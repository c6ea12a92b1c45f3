"""Property-market analytics on Spark: listings, series, price indexes, statistics and crawl coverage."""
