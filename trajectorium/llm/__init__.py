"""Operations of a training-data pipeline over text, pages and embeddings."""
