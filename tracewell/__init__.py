"""tracewell: evidence recall and corpus preparation as DataFrame programs."""
