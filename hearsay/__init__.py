"""hearsay: review analytics and corpus preparation as ordinary Spark queries."""
