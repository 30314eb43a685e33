"""Search ranking over Spark tables: BM25 retrieval, features, learned reranking, blending, evaluation."""

from rankloom.config import RankingConfig

__all__ = ["RankingConfig"]
