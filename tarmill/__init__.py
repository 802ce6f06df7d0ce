"""tarmill: Spark-first operators for speech-transcript corpora: scoring, split building, standardisation and audit."""

__all__ = ["runtime"]
