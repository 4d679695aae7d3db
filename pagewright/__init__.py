"""A Spark-first document-analytics engine: pages, lines, boxes, blocks and tokens are rows."""
