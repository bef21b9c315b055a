"""Search index over a catalogue: copies, postings, the best postings of each term, and blocks with their largest weights."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartwise import constants as K
from cartwise.functions import text as X
from cartwise.operators import tfidf as TF

BUCKETS = 64  # blocks of a list, by weight


@dataclass(frozen=True)
class SearchIndex:
    """Tables of an index. ``k`` is the largest result list they can answer exactly."""

    vocab: DataFrame      # term, fid, space, idf, tf, df
    members: DataFrame    # gid, copies, ordinal, product_id
    postings: DataFrame   # gid, tid, bucket, dense, sparse
    heads: DataFrame      # tid, gid, dense, sparse: postings among the k largest weights of their term in a space
    blocks: DataFrame     # tid, bucket, n, top_dense, top_sparse: at most BUCKETS rows a term
    k: int

    @property
    def bounds(self) -> DataFrame:
        """Per term the length of its list, the largest weights, and the ``k``-th largest; 0 for lists shorter than ``k``."""
        span = self.blocks.groupBy("tid").agg(
            F.sum("n").alias("list_length"), F.max("top_dense").alias("top_dense"), F.max("top_sparse").alias("top_sparse"))
        kth = [_ranked(self.heads, w, self.k).filter(F.col("rn") == self.k).select("tid", F.col(w).alias(f"kth_{w}")) for w in ("dense", "sparse")]
        return span.join(kth[0], "tid", "left").join(kth[1], "tid", "left").fillna(0.0)


def with_corpus_text(products: DataFrame) -> DataFrame:
    return products.withColumn(
        "text", X.corpus_text(F.col("name"), F.col("desc"), F.col("category"), F.col("brand"))
    )


def copy_groups(products: DataFrame, k: int, stock_only: bool = True) -> DataFrame:
    """Products grouped by equal text: (gid, copies, ordinal, product_id, text, lead).

    Equal text means equal vectors and scores, so only the first ``k`` products of a group in
    catalogue order can be among the best ``k`` of a query. The rank limit runs before the shuffle,
    so a text shared by a third of the catalogue sends ``k`` rows per task.
    """
    pool = products.filter(F.coalesce("stock", F.lit(True))) if stock_only else products
    order = Window.partitionBy("text").orderBy("ordinal")
    kept = (
        pool.select("text", "ordinal", "product_id")
        .withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k)
    )
    whole = Window.partitionBy("text")
    return kept.select(
        F.min("ordinal").over(whole).alias("gid"), F.count("*").over(whole).alias("copies"),
        "ordinal", "product_id", "text", (F.col("rn") == 1).alias("lead"),
    )


def postings(groups: DataFrame, vocab: DataFrame) -> DataFrame:
    """Weights of every distinct text, with the bucket of the larger one for pruned reading."""
    leads = groups.filter("lead")
    weights = TF.hybrid_tfidf(leads, "gid", "text", vocab)
    larger = F.greatest("dense", "sparse")
    return weights.select(
        "gid", "tid", F.floor(larger * BUCKETS).cast("int").alias("bucket"), "dense", "sparse"
    )


def _ranked(post: DataFrame, weight: str, k: int) -> DataFrame:
    """The ``k`` largest weights of each term. The rank limit runs before the shuffle."""
    order = Window.partitionBy("tid").orderBy(F.desc(weight), "gid")
    return post.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k)


def term_heads(post: DataFrame, k: int) -> DataFrame:
    columns = ("tid", "gid", "dense", "sparse")
    return _ranked(post, "dense", k).select(*columns).union(_ranked(post, "sparse", k).select(*columns)).distinct()


def term_blocks(post: DataFrame) -> DataFrame:
    return post.groupBy("tid", "bucket").agg(
        F.count("*").alias("n"), F.max("dense").alias("top_dense"), F.max("sparse").alias("top_sparse"))


def build_index(products: DataFrame, keep, k: int = K.TOP_CANDIDATES, stock_only: bool = True,
                vocab: DataFrame | None = None) -> SearchIndex:
    """Fit the vocabularies on the whole catalogue (unless given) and index it.

    ``keep(df, label)`` stores a table and reads it back: ``session.stage`` or a writer to a path.
    """
    texts = with_corpus_text(products)
    if vocab is None:
        vocab = keep(TF.fit_hybrid_vocab(texts, "text"), "vocab")
    groups = keep(copy_groups(texts, k, stock_only), "copy-groups")
    post = keep(postings(groups, vocab), "postings")
    heads, blocks = keep(term_heads(post, k), "term-heads"), keep(term_blocks(post), "term-blocks")
    return SearchIndex(vocab, groups.select("gid", "copies", "ordinal", "product_id"), post, heads, blocks, k)


def update_index(index: SearchIndex, before: DataFrame, after: DataFrame, changed: DataFrame, keep, stock_only: bool = True) -> SearchIndex:
    """The index of the catalogue ``after``, from that of ``before``, with the vocabularies fitted then.

    ``changed`` are the product_ids that were added, replaced or removed. Only the groups of equal text
    that such a product left or joined are formed again, and only heads and blocks of terms they hold or held.
    """
    def having(products: DataFrame) -> DataFrame:
        """Products of a text that a changed product has or had; a missing text counts as one."""
        texts = with_corpus_text(products)
        return texts.join(touched, texts["text"].eqNullSafe(touched["_text"]), "left_semi")

    ids = changed.select("product_id").distinct()
    touched = with_corpus_text(before).join(ids, "product_id", "left_semi").select(F.col("text").alias("_text")).union(
        with_corpus_text(after).join(ids, "product_id", "left_semi").select("text")).distinct()
    touched = keep(touched, "touched-texts")
    gone = keep(copy_groups(having(before), index.k, stock_only).select("gid").distinct(), "groups-gone")
    groups = keep(copy_groups(having(after), index.k, stock_only), "groups-new")
    fresh = keep(postings(groups, index.vocab), "postings-new")
    terms = keep(index.postings.join(gone, "gid", "left_semi").select("tid").union(fresh.select("tid")).distinct(), "terms-touched")
    post = keep(index.postings.join(gone, "gid", "left_anti").unionByName(fresh), "postings")
    again = post.join(terms, "tid", "left_semi")
    heads = index.heads.join(terms, "tid", "left_anti").unionByName(term_heads(again, index.k))
    blocks = index.blocks.join(terms, "tid", "left_anti").unionByName(term_blocks(again))
    members = index.members.join(gone, "gid", "left_anti").unionByName(groups.select("gid", "copies", "ordinal", "product_id"))
    return SearchIndex(index.vocab, keep(members, "members"), post, keep(heads, "term-heads"), keep(blocks, "term-blocks"), index.k)
