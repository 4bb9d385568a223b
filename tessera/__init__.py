"""Analytics over nested public-record collections, as PySpark jobs."""
