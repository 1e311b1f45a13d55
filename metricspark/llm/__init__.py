"""Operations of a training-data pipeline: duplicates, filters, formats and tokens at corpus scale."""
