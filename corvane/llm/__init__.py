"""Operations of a training-data pipeline over text corpora, as Spark jobs.

Nothing outside this subpackage imports it.
"""
