"""Full-text index and matching.

Postings are (token, id, field, tf): one explode of the tokenized fields and
one ``groupBy`` with map-side partial counts.  A query never shuffles the
postings: its terms are a literal ``IN`` filter (pushed into the scan and, on
a token-sorted postings table, into row-group skipping); only the matching
(id, token) rows meet the per-document length table.  Per-term document
frequencies aggregate to one row per term, and N / avgdl are scalar
subqueries, so a frequent term (one that occurs in a third of all documents)
never lands in a single task.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsift.functions.text import WORD_TOKEN, fold, standard_tokens, trigrams

# Field weights of the ranking (name, content, title, path).
FIELD_WEIGHTS = {"name": 8.0, "content": 3.0, "title": 8.0, "path": 5.0}
# Metadata boosts of the fielded query.
METADATA_BOOSTS = {"name": 8.0, "content": 3.0, "album": 8.0, "artist": 8.0, "title": 8.0, "genre": 2.0,
                   "album_artist": 8.0, "font_name": 6.0, "path": 5.0}
BM25_K1 = 1.2  # fixed value
BM25_B = 0.75  # fixed value
IDF_FLOOR = 1e-6  # fixed value: a non-positive idf is replaced by this
FUZZY_BOOSTS = {"content": 1.0, "name": 3.0, "path": 1.0}  # fixed values
SNIPPET_TOKENS = 20  # fixed value


def fold_terms(terms: list[str]) -> list[str]:
    """Query terms through the same folding as the index (Python side)."""
    from docsift.functions.text import FOLD_FROM, FOLD_MULTI, FOLD_TO

    table = str.maketrans(FOLD_FROM, FOLD_TO)
    out = []
    for t in terms:
        s = t.lower().translate(table)
        for a, b in FOLD_MULTI:
            s = s.replace(a, b)
        out.append(s)
    return out


# ------------------------------------------------------------------ indexing

def _size0(arr: Column) -> Column:
    """Array length, 0 for NULL (whatever the session's size-of-null rule)."""
    return F.when(arr.isNull(), F.lit(0)).otherwise(F.size(arr))


def field_tokens(docs: DataFrame, fields=tuple(FIELD_WEIGHTS), id_col: str = "id") -> DataFrame:
    """(id, field, token) per token occurrence."""
    arr = F.array(*[F.struct(F.lit(f).alias("field"), standard_tokens(F.col(f)).alias("toks")) for f in fields])
    return (docs.select(F.col(id_col).alias("id"), F.inline(arr))
            .select("id", "field", F.explode("toks").alias("token")))


def build_postings(docs: DataFrame, fields=tuple(FIELD_WEIGHTS), id_col: str = "id") -> DataFrame:
    """T4: inverted index (token, id, field, tf)."""
    return field_tokens(docs, fields, id_col).groupBy("token", "id", "field").agg(F.count(F.lit(1)).alias("tf"))


def doc_lengths(docs: DataFrame, fields=tuple(FIELD_WEIGHTS), id_col: str = "id") -> DataFrame:
    """Per-document token count summed over the fields; row-local, no shuffle."""
    total = functools.reduce(lambda a, b: a + b,
                             [_size0(standard_tokens(F.col(f))) for f in fields])
    return docs.select(F.col(id_col).alias("id"), total.cast("long").alias("dl"))


def write_postings(postings: DataFrame, path: str, buckets: int | None = None) -> None:
    """Lay postings out range-partitioned and sorted by (token, id), so a
    term lookup reads few files and row groups (min/max skipping).  The range
    key includes the id: a term found in a third of all documents is spread
    over many consecutive files instead of landing in one task."""
    n = buckets or postings.sparkSession.conf.get("spark.sql.shuffle.partitions")
    write_in_order(postings, path, ["token", "id"], n=int(n))


def write_in_order(rows: DataFrame, path: str, by: list[str], n: int | None = None, also: tuple[str, ...] = (), keep: bool = True) -> None:
    """Rows in the order of ``by`` (and ``also`` within a partition).  The bounds
    of the partitions come from a first look at the rows, so these are kept on
    the executors' disks until written and not computed twice; with ``keep``
    False, for rows that are stored anyway, they are read twice."""
    kept = rows.persist(StorageLevel.DISK_ONLY) if keep else rows
    try:
        (kept.repartitionByRange(*([n] if n else []), *by).sortWithinPartitions(*by, *also)
         .write.mode("overwrite").parquet(path))
    finally:
        if keep:
            kept.unpersist()


# ------------------------------------------------------------------- scoring

def _weight(weights: dict[str, float]) -> Column:
    expr = None
    for f, w in weights.items():
        expr = F.when(F.col("field") == f, F.lit(w)) if expr is None else expr.when(F.col("field") == f, F.lit(w))
    return expr.otherwise(F.lit(0.0))


def bm25(postings: DataFrame, lengths: DataFrame | None, terms: list[str], weights: dict[str, float] | None = None,
         fields: list[str] | None = None, require_all: bool = True,
         k1: float = BM25_K1, b: float = BM25_B, stats: DataFrame | None = None,
         frequency: DataFrame | None = None) -> DataFrame:
    """Weighted BM25 of the documents matching ``terms``.

    idf = ln((N - n + 0.5) / (n + 0.5)) floored at 1e-6; the field weight
    multiplies tf; document length sums all fields.  ``require_all`` gives
    the implicit AND (T6), otherwise OR (T7).  ``fields`` restricts matching
    and scoring to those fields (T10).  Returns (id, score).

    With a persisted index (see ``build_text_index``) the postings carry the
    document length ``dl`` and ``stats`` holds N and avgdl, so a query reads
    only the postings rows of its terms: no join, no scan of other tables.
    """
    weights = weights or FIELD_WEIGHTS
    qterms = sorted(set(fold_terms(terms)))
    p = postings.where(F.col("token").isin(qterms))
    if fields is not None:
        p = p.where(F.col("field").isin(list(fields)))
    has_dl = "dl" in postings.columns
    keys = ["id", "token"] + (["dl"] if has_dl else [])
    f = p.groupBy(*keys).agg(F.sum(F.col("tf") * _weight(weights)).alias("f"))
    if not has_dl:
        f = f.join(lengths, "id")
    if stats is None:
        stats = lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))
    return score_matches(f, stats, len(qterms) if require_all else None, k1, b, frequency)


def score_matches(f: DataFrame, stats: DataFrame, all_of: int | None = None, k1: float = BM25_K1, b: float = BM25_B,
                  frequency: DataFrame | None = None) -> DataFrame:
    """BM25 (id, score) of the matches (id, token, dl, f), where ``token`` is
    a term, a phrase or a prefix and ``f`` its weighted count in the document;
    with ``all_of`` only documents that match so many of them.  ``frequency``:
    stored (token, n); without it the matches are counted."""
    n = f.groupBy("token").agg(F.count(F.lit(1)).alias("n")) if frequency is None else frequency
    n_docs = stats.select("n_docs").scalar()
    avgdl = stats.select("avgdl").scalar()
    idf_raw = F.ln((n_docs - F.col("n") + 0.5) / (F.col("n") + 0.5))
    idf = F.when(idf_raw <= 0, F.lit(IDF_FLOOR)).otherwise(idf_raw)
    # n holds one row per query term: bounded by the request, safe to broadcast.
    scored = (f.join(F.broadcast(n), "token")
              .select("id", "token",
                      (idf * F.col("f") * (k1 + 1)
                       / (F.col("f") + k1 * (1 - b + b * F.col("dl") / avgdl))).alias("s")))
    agg = scored.groupBy("id").agg(F.sum("s").alias("score"), F.count(F.lit(1)).alias("_nt"))
    if all_of is not None:
        agg = agg.where(F.col("_nt") == all_of)
    return agg.select("id", "score")


class TextIndex:
    """A text index: postings (token, id, field, tf, dl), laid out
    range-partitioned and sorted by token, with positions (``pos``) if it has
    them, a one-row stats table, and the 3-grams (gram, id, field) if stored."""

    def __init__(self, postings: DataFrame, stats: DataFrame, grams: DataFrame | None = None):
        self.postings = postings
        self.stats = stats
        self.grams = grams

    def document_frequency(self, tokens: list[str], fields: list[str] | None = None) -> DataFrame | None:
        """Stored (token, n); None if the index has no such counts."""
        return None

    def bm25(self, terms, **kw) -> DataFrame:
        tokens = sorted(set(fold_terms(terms)))
        return bm25(self.postings, None, terms, stats=self.stats, frequency=self.document_frequency(tokens, kw.get("fields")), **kw)

    def prefix_scores(self, prefix: str, fields: list[str] | None = None) -> DataFrame:
        """T9 ranked: all tokens with the prefix count as one term."""
        start = fold_terms([prefix])[0]
        p = self.postings.where(F.col("token").startswith(start))
        if fields is not None:
            p = p.where(F.col("field").isin(list(fields)))
        f = p.groupBy("id", "dl").agg(F.sum(F.col("tf") * _weight(FIELD_WEIGHTS)).alias("f"))
        return score_matches(f.withColumn("token", F.lit(start)), self.stats)

    def phrase_scores(self, docs: DataFrame, phrase: list[str], fields: list[str] | None = None) -> DataFrame:
        """T8 ranked: the occurrences of the phrase in the fields (all, or the
        given ones) count as those of one term.  With positions the postings
        alone decide; else the texts that hold all its words are read."""
        words = fold_terms(phrase)
        fields = list(FIELD_WEIGHTS) if fields is None else list(fields)
        if "pos" in self.postings.columns:
            found = phrase_matches(self.postings, words, fields)
        else:
            found = functools.reduce(lambda a, b: a.unionByName(b), [
                docs.join(match_all(self.postings, words, [x]), "id", "left_semi").select("id", F.lit(x).alias("field"), F.regexp_count(
                    fold(F.col(x)), F.lit(phrase_pattern(words, False))).cast("long").alias("tf")) for x in fields]).where(F.col("tf") > 0)
            lengths = self.postings.where((F.col("token") == words[0]) & F.col("field").isin(fields)).select("id", "dl").distinct()
            found = found.join(lengths, "id")
        f = found.groupBy("id", "dl").agg(F.sum(F.col("tf") * _weight(FIELD_WEIGHTS)).alias("f"))
        return score_matches(f.withColumn("token", F.lit(" ".join(words))), self.stats)


def _moved(places: Column, back: int) -> Column:
    return F.transform(places, lambda p: p - back)


def phrase_matches(postings: DataFrame, words: list[str], fields: list[str] | None = None) -> DataFrame:
    """(id, field, dl, tf): where the words stand next to each other, in order,
    and how often.  Decided on positions: the places of the i-th word, moved
    back by i, that all words share are the starts of the phrase."""
    wanted = sorted(set(words))
    p = postings.where(F.col("token").isin(wanted))
    if fields is not None:
        p = p.where(F.col("field").isin(list(fields)))
    # one row for each different word, so a group is as small as the phrase
    per = (p.groupBy("id", "field").agg(F.map_from_entries(F.collect_list(F.struct("token", "pos"))).alias("m"), F.max("dl").alias("dl"))
           .where(F.size("m") == len(wanted)))
    shared = functools.reduce(F.array_intersect, [_moved(F.col("m")[w], i) for i, w in enumerate(words)])
    return per.select("id", "field", "dl", F.size(shared).cast("long").alias("tf")).where(F.col("tf") > 0)


def build_text_index(docs: DataFrame, path: str, fields=tuple(FIELD_WEIGHTS), id_col: str = "id",
                     positions: bool = False) -> TextIndex:
    """T4 + I12 for a text index that stays as it is (``segments`` has one that
    is kept current): every document is tokenized and counted in its row, the
    postings carry the document's length (and, with ``positions``, the places of
    the token), so no query joins back to a length table or reads a text.  One
    range shuffle lays them out in (token, id) order; N / avgdl are a one-row
    table."""
    from docsift.operators.runs import write_document_postings

    spark = docs.sparkSession
    write_document_postings(docs.select(id_col, *fields), f"{path}/postings", fields, id_col,
                            "token string, id long, field string, tf long, dl long" + (", pos array<int>" if positions else ""),
                            FIELD_WEIGHTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    n_docs = docs.select(F.count(F.lit(1))).scalar()
    total = spark.read.parquet(f"{path}/postings").select(F.sum("tf").cast("double")).scalar()
    (spark.range(1).select(n_docs.alias("n_docs"), (F.coalesce(total, F.lit(0.0)) / n_docs).alias("avgdl"))
     .write.mode("overwrite").parquet(f"{path}/stats"))
    return open_text_index(spark, path)


def open_text_index(spark, path: str) -> TextIndex:
    return TextIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/stats"))


def match_all(postings: DataFrame, terms: list[str], fields: list[str] | None = None) -> DataFrame:
    """Ids having every term in some field (no scoring)."""
    q = sorted(set(fold_terms(terms)))
    p = postings.where(F.col("token").isin(q))
    if fields is not None:
        p = p.where(F.col("field").isin(list(fields)))
    return (p.groupBy("id").agg(F.count_distinct("token").alias("_n"))
            .where(F.col("_n") == len(q)).select("id"))


def match_any(postings: DataFrame, terms: list[str]) -> DataFrame:
    """T7 OR: ids having at least one term."""
    return postings.where(F.col("token").isin(sorted(set(fold_terms(terms))))).select("id").distinct()


def match_not(docs: DataFrame, postings: DataFrame, terms: list[str], id_col: str = "id") -> DataFrame:
    """T7 NOT: documents having none of the terms (anti join)."""
    bad = match_any(postings, terms)
    return docs.join(bad, docs[id_col] == bad["id"], "left_anti") if id_col != "id" else \
        docs.join(bad, "id", "left_anti")


def match_prefix(postings: DataFrame, prefix: str) -> DataFrame:
    """Ids with a token starting with ``prefix``."""
    p = fold_terms([prefix])[0]
    return postings.where(F.col("token").startswith(p)).select("id").distinct()


def match_phrase(docs: DataFrame, postings: DataFrame, phrase: list[str], field: str = "content") -> DataFrame:
    """Adjacent tokens in order.  With positional postings (``pos``) the
    match is decided on the postings alone; without positions the candidates
    (all words present) are verified with one regex on their folded text."""
    words = fold_terms(phrase)
    if "pos" in postings.columns:
        return phrase_matches(postings, words, [field]).select("id")
    cand = match_all(postings, words, [field])
    return docs.join(cand, "id", "left_semi").where(fold(F.col(field)).rlike(phrase_pattern(words))).select("id")


def phrase_pattern(words: list[str], consume: bool = True) -> str:
    """Adjacent tokens in a folded text: the words separated only by non-word
    characters; one regex scan per candidate, no token arrays.  Without
    ``consume`` the character behind a match may begin the next one."""
    sep = r"[^\p{L}\p{N}]"
    body = f"{sep}+".join(f"\\Q{w}\\E" for w in words)
    return f"(^|{sep}){body}({sep}|$)" if consume else f"(?<![\\p{{L}}\\p{{N}}]){body}(?![\\p{{L}}\\p{{N}}])"


def match_fuzzy(docs: DataFrame, text: str, in_path: bool = False) -> DataFrame:
    """3-gram match: every gram of the query occurs in content, name
    (or path when enabled); score = sum of the boosts of the fields that
    contain each gram.  Row-local containment tests, no shuffle."""
    q = fold_terms([text])[0]
    grams = sorted({q[i:i + 3] for i in range(max(len(q) - 2, 0))})
    fields = ["content", "name"] + (["path"] if in_path else [])
    folded = {f: fold(F.col(f)) for f in fields}
    present = [F.greatest(*[F.instr(folded[f], g) > 0 for f in fields]) if len(fields) > 1
               else F.instr(folded[fields[0]], g) > 0 for g in grams]
    everyone = functools.reduce(lambda a, b: a & b, present) if present else F.lit(False)
    score = functools.reduce(lambda a, b: a + b, [
        F.when(F.instr(folded[f], g) > 0, F.lit(FUZZY_BOOSTS[f])).otherwise(F.lit(0.0))
        for g in grams for f in fields]) if grams else F.lit(0.0)
    return docs.where(everyone).select("id", score.alias("score"))


def trigram_postings(docs: DataFrame, fields: list[str], id_col: str = "id") -> DataFrame:
    """T2 index: distinct (gram, id, field), made distinct in the row.  Texts are
    folded in the JVM; a run of rows then has its characters cut as numbers, so
    no string is made for a place in a text, only one for each gram."""
    rows = docs.select(F.col(id_col).alias("id"), *[fold(F.col(f)).alias(f"t{i}") for i, f in enumerate(fields)])
    id_type = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, f in enumerate(fields):
                for ids, texts in text_runs(batch.column(0), batch.column(1 + i)):
                    row, gram, strings = distinct_grams(texts)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(row)), pa.array([f]).take(pa.array(np.zeros(len(row), dtype=np.int64))), strings.take(pa.array(gram))],
                        names=["id", "field", "gram"])

    return rows.mapInArrow(cut, f"id {id_type}, field string, gram string")


RUN_BYTES = 4 << 20  # of texts whose characters are cut at once


def text_runs(ids: pa.Array, texts: pa.Array) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Neighbouring rows in runs of about ``RUN_BYTES``, one row at least."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    run = np.cumsum(sizes) // RUN_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1), len(run)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield ids.slice(a, b - a), texts.slice(a, b - a)


def distinct_grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, gram number) of the distinct 3-grams of some texts, and the grams."""
    words = pc.fill_null(texts, "").to_pylist()
    n_chars = np.array([len(w) for w in words], dtype=np.int64)
    chars = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
    row = np.repeat(np.arange(len(words), dtype=np.int64), n_chars)
    inside = row[2:] == row[:-2] if len(row) > 2 else np.zeros(0, dtype=bool)
    used = np.zeros(0x110000, dtype=bool)
    used[chars] = True
    letters = np.flatnonzero(used)
    number = np.zeros(0x110000, dtype=np.int64)
    number[letters] = np.arange(len(letters))
    code, n = number[chars], len(letters)
    if not inside.any():
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), pa.array([], pa.string())
    key = ((code[:-2] * n + code[1:-1]) * n + code[2:])[inside]
    row = row[2:][inside]
    if n ** 3 * len(words) < 1 << 62:
        both = np.sort(key * len(words) + row)
        both = both[np.append(True, both[1:] != both[:-1])]
        key, row = both // len(words), both % len(words)
    else:
        order = np.lexsort((row, key))
        key, row = key[order], row[order]
        new = np.append(True, (key[1:] != key[:-1]) | (row[1:] != row[:-1]))
        key, row = key[new], row[new]
    begins = np.append(True, key[1:] != key[:-1])
    grams = key[begins]
    text = letters[np.stack([grams // (n * n), grams // n % n, grams % n], axis=1)].astype(np.uint32).tobytes().decode("utf-32-le")
    return row, np.cumsum(begins) - 1, pa.array([text[i:i + 3] for i in range(0, len(text), 3)], pa.string())


def write_trigram_index(docs: DataFrame, path: str, fields=tuple(FUZZY_BOOSTS), id_col: str = "id") -> None:
    """T2 stored: (gram, id, field) in gram order, so that a fuzzy search
    reads the rows of its grams only."""
    from docsift.operators.runs import write_document_grams

    write_document_grams(docs.select(id_col, *fields), path, fields, id_col, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def match_fuzzy_index(grams: DataFrame, text: str, in_path: bool = False) -> DataFrame:
    """T11 on the stored 3-grams: the same (id, score) as ``match_fuzzy``
    without a look at any text."""
    q = fold_terms([text])[0]
    wanted = sorted({q[i:i + 3] for i in range(max(len(q) - 2, 0))})
    fields = ["content", "name"] + (["path"] if in_path else [])
    boost = None
    for f in fields:
        boost = F.when(F.col("field") == f, FUZZY_BOOSTS[f]) if boost is None else boost.when(F.col("field") == f, FUZZY_BOOSTS[f])
    hits = grams.where(F.col("gram").isin(wanted) & F.col("field").isin(fields))
    found = hits.groupBy("id").agg(F.count_distinct("gram").alias("_n"), F.sum(boost).alias("score"))
    return found.where(F.col("_n") == len(wanted)).select("id", "score")


# --------------------------------------------------------------- highlights

def _is_term(tok: Column, terms: list[str]) -> Column:
    return F.array_contains(F.array(*[F.lit(t) for t in terms]), tok)


def highlight(docs: DataFrame, terms: list[str], field: str = "content", n: int = SNIPPET_TOKENS) -> DataFrame:
    """Best window of ``n`` tokens with the words of hits wrapped in <mark>.

    A hit is a word of ``terms`` or, where a term has several words, those words
    next to each other.  The window begins at a hit and scores 1000 for every
    different term of which a hit lies whole in it, and 1 for every further hit;
    the first of the best is shown, without any hit the first ``n`` tokens.
    Tokens are joined by single spaces.  Only the places of query words leave the
    JVM; scoring is one pass over them."""
    parts = [w.split() for w in fold_terms(terms)]
    col = F.col(field)
    # Arrays are materialised as columns first: a lambda that refers to an
    # expression (not a column) would re-evaluate it for every element.
    base = docs.select("id", F.regexp_extract_all(col, F.lit(WORD_TOKEN), 0).alias("_ot"),
                       F.regexp_extract_all(fold(col), F.lit(WORD_TOKEN), 0).alias("_ft"))
    words = sorted({w for p in parts for w in p})
    base = base.withColumn("_at", F.filter(F.transform("_ft", lambda t, i: F.struct(i.alias("place"), t.alias("word"))),
                                           lambda s: _is_term(s["word"], words) if words else F.lit(False)))

    @F.pandas_udf("struct<start:int,marked:array<int>>")
    def window(places: pd.Series) -> pd.DataFrame:
        shown = [best_window([(x["place"], x["word"]) for x in row] if row is not None else [], parts, n) for row in places]
        return pd.DataFrame({"start": [s for s, _ in shown], "marked": [m for _, m in shown]})

    base = base.withColumn("_w", window("_at"))
    otoks, start, marked = F.col("_ot"), F.col("_w.start") + 1, F.col("_w.marked")
    idx = F.sequence(start, F.least(start + n - 1, F.size(otoks)))
    pieces = F.transform(idx, lambda i: F.when(F.array_contains(marked, i - 1), F.concat(F.lit("<mark>"), F.try_element_at(otoks, i), F.lit("</mark>")))
                         .otherwise(F.try_element_at(otoks, i)))
    snippet = F.when(F.size(otoks) == 0, F.lit("")).otherwise(F.array_join(pieces, " "))
    return base.select("id", snippet.alias("snippet"))


def best_window(places: list[tuple[int, str]], parts: list[list[str]], n: int) -> tuple[int, list[int]]:
    """Start of the best window of ``n`` tokens and the places in it to mark,
    from the places of all query words, in order."""
    at = dict(places)
    hits = []  # (start, end, part)
    for part, words in enumerate(parts):
        hits += [(p, p + len(words), part) for p, w in places if w == words[0] and all(at.get(p + i) == x for i, x in enumerate(words))]
    hits.sort()
    by_end = sorted(hits, key=lambda h: h[1])
    held: dict[int, int] = {}
    best, top, total, added, gone = 0, -1, 0, 0, 0
    for start, _, _ in hits:
        while added < len(by_end) and by_end[added][1] <= start + n:
            begin, _, part = by_end[added]
            if begin >= start:
                held[part] = held.get(part, 0) + 1
                total += 1
            added += 1
        while hits[gone][0] < start:
            _, end, part = hits[gone]
            if end <= hits[gone][0] + n:  # it was held
                held[part] -= 1
                total -= 1
            gone += 1
        different = sum(c > 0 for c in held.values())
        score = 1000 * different + total - different
        if score > top:
            best, top = start, score
    inside = sorted({i for s, e, _ in hits if s >= best and e <= best + n for i in range(s, e)})
    return best, inside


def highlight_page(docs: DataFrame, page: DataFrame, terms: list[str], field: str = "content",
                   n: int = SNIPPET_TOKENS, id_col: str = "id") -> DataFrame:
    """T13 for one result page: the page (at most ``MAX_PAGE`` rows, a bounded
    list) is computed once and its ids become a literal ``IN`` filter on the
    documents, pushed into the scan: only the page's texts are tokenized and
    highlighted.  Documents stored in id order skip the other row groups; in
    any other layout their ids are still read."""
    from docsift.operators.search import MAX_PAGE

    rows = page.limit(MAX_PAGE + 1).collect()
    if len(rows) > MAX_PAGE:
        raise ValueError(f"a page holds at most {MAX_PAGE} rows")
    shown = docs.sparkSession.createDataFrame(rows, page.schema)
    texts = docs.where(F.col(id_col).isin([r[id_col] for r in rows])).select(F.col(id_col).alias("id"), field)
    snippets = highlight(texts, terms, field, n)
    return shown.join(snippets.withColumnRenamed("id", id_col), id_col, "left")


def highlight_full(docs: DataFrame, terms: list[str], field: str = "content") -> DataFrame:
    """The whole text with every hit word wrapped in <mark>; separators kept."""
    q = fold_terms(terms)
    col = F.col(field)
    words = F.regexp_extract_all(col, F.lit(WORD_TOKEN), 0)
    seps = F.split(col, WORD_TOKEN, -1)
    pieces = F.zip_with(words, F.slice(seps, 2, F.greatest(F.size(seps) - 1, F.lit(1))),
                        lambda w, s: F.concat(
                            F.when(_is_term(fold(w), q), F.concat(F.lit("<mark>"), w, F.lit("</mark>"))).otherwise(w),
                            F.coalesce(s, F.lit(""))))
    return docs.select("id", F.concat(F.try_element_at(seps, F.lit(1)), F.array_join(pieces, "")).alias("marked"))
