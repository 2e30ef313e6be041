"""Operations of a training-data pipeline over text corpora, each a set of Spark jobs."""
