"""Evidence retrieval, typed financial facts and corpus preparation as Spark DataFrame programs."""
