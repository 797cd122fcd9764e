"""Operations of training-data pipelines over text tables, each a Spark job.

Nothing outside this package imports it; ``queries`` in :mod:`wayline.llm.registry` lists what it offers.
"""
