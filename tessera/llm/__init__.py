"""Operations of a training-data pipeline: thirteen operators and the queries that apply them.

Nothing outside this package imports it; ``queries.py`` registers one query per operator.
"""
