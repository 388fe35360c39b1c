"""Spark jobs over long multichannel recordings, and over text corpora in ``wavemill.llm``."""
