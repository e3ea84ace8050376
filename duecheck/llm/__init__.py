"""Operations of a training-data pipeline, each built on Spark tables of documents."""
