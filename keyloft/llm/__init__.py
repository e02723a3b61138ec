"""Operations of a training-data pipeline: scoring, deduplication, mixing,
packing, language identification, licence and secret scans, exact search.

Nothing outside this subpackage imports it.
"""
