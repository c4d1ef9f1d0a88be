"""mediacat: catalogues of exported photo and video collections as Spark jobs."""
