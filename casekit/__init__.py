"""Analytics over corpora of long labelled documents, on Spark SQL."""
