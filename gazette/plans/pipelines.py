"""The two digest pipelines as functions on DataFrames.

Every stage is lazy; an empty stage gives an empty result and a header with
zero counts. Articles are ``article_id, pos, title, description, source,
language, vec`` (``vec`` may be null: such an article is ``unknown`` and noise).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from gazette import dims
from gazette.operators import classify as C
from gazette.operators import cluster as G
from gazette.operators import collect as P
from gazette.operators import digest as D
from gazette.operators import relevance as R
from gazette.operators import store as K
from gazette.session import ensure_checkpoint_dir


class DigestRun(NamedTuple):
    collected: DataFrame      # what the run started from after collection or the store read
    classified: DataFrame
    members: DataFrame        # classified (relevant) articles with their cluster
    clusters: DataFrame
    items: DataFrame
    digest: DataFrame


def _events(classified: DataFrame, eps: float, min_samples: int, max_events: int, as_of: str, language: str):
    members = G.cluster_members(classified, eps, min_samples)
    table = G.clusters(members)
    items = D.digest_items(G.top_clusters(table, n=max_events), members, max_items=max_events, language=language)
    return members, table, items, D.digest(items, as_of)


def run_digest(articles: DataFrame, prototypes: DataFrame, as_of: str, max_total: int | None = 100, per_source: int = 30,
               lang: str | None = "en", max_chars: int = 800, eps: float = 0.35, min_samples: int = 2, max_events: int = 7,
               language: str = "english") -> DigestRun:
    """Collect -> classify (nearest prototype) -> cluster -> top events -> digest."""
    ensure_checkpoint_dir(articles.sparkSession)
    collected = P.collect_pipeline(articles, max_total, per_source, lang, max_chars).checkpoint()
    classified = C.classify_nearest(collected, prototypes)
    return DigestRun(collected, classified, *_events(classified, eps, min_samples, max_events, as_of, language))


def run_digest_gated(store: DataFrame, vectors: DataFrame, prototypes: DataFrame, as_of: str, limit: int | None = None,
                     irrelevant=dims.IRRELEVANT_KEYWORDS, relevant=dims.RELEVANT_KEYWORDS, eps: float = 0.35,
                     min_samples: int = 2, max_events: int = 7, language: str = "english") -> DigestRun:
    """Store read -> gate + classify -> cluster the relevant -> digest with run counts.

    ``vectors`` is ``(article_id, vec)``; stored articles without one stay.
    """
    ensure_checkpoint_dir(store.sparkSession)
    read = K.get_articles(store, limit=limit)
    arts = K.normalize_store_articles(read).selectExpr("*", "cast(id AS long) AS article_id", "cast(id AS long) AS pos")
    arts = arts.join(vectors.select("article_id", "vec"), "article_id", "left")
    # the classified table feeds clustering, the digest and the run counts
    classified = C.classify_gated(arts, prototypes, irrelevant, relevant).checkpoint()
    kept, _ = R.split_relevance(classified)
    members, table, items, dig = _events(kept, eps, min_samples, max_events, as_of, language)
    return DigestRun(read, classified, members, table, items, D.digest_metadata(dig, classified))
