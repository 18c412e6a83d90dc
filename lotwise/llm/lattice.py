"""SentencePiece encoding by a relational lattice, and decoding.

Texts are cut into words that no piece crosses, and each distinct word of the corpus is segmented once: its substrings
up to the longest piece are exploded and equi-joined to the piece table, which gives the edges of its lattice; edges are
grouped by word, and a fold over them by the higher-order ``aggregate`` keeps the best path to each (end, last piece).

Models of merges (byte-pair encoding) are no sums of scores: a path is the encoding exactly when no piece and no
neighbouring pair of pieces on it would be merged otherwise. Those pairs are the only steps the fold may take there; a
small helper runs the merges on pieces and pairs and remembers the answers. Unigram models step anywhere.

The dictionary is joined back to the words of the texts: the ``hot`` most frequent by broadcast (a fixed bound), the
others by shuffle, so a frequent word is no hot key. A text's words are never gathered unless ``assemble`` is asked to.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm.common import stage, whole_text

SPACE = "▁"
HOT_WORDS = 200_000
SLICE = 256
# An edge over a character outside the vocabulary has this less its place as id.
OUTSIDE = -2
# Distinct words segmented in one task: the edges of their lattices are grouped there and fit into its memory.
WORDS_PER_TASK = 20_000
PIECES = "id int, piece string, score double, kind string, hex string"
_WORD = f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+"
# For vocabularies without a piece that goes on after letters with anything else: a word ends with its letters.
_LETTERS = f"\n|{SPACE}*[^{SPACE}\n\\p{{L}}]*\\p{{L}}+|{SPACE}*[^{SPACE}\n\\p{{L}}]+|{SPACE}+"


def load_pieces(spark: SparkSession, path: str) -> DataFrame:
    """The piece table of a model file (its vocabulary bounds it): id, piece, score, kind and the bytes it stands for."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        special = model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
        kind = "byte" if model.is_byte(i) else "special" if special else "normal"
        data = bytes([int(piece[3:5], 16)]) if kind == "byte" else b"" if special else piece.replace(SPACE, " ").encode()
        rows.append((i, piece, float(model.get_score(i)), kind, data.hex()))
    crossing = [r[1] for r in rows if r[3] == "normal" and (re.search(f"[^{SPACE}]{SPACE}", r[1]) or "\n" in r[1] and len(r[1]) > 1)]
    if crossing:
        raise ValueError(f"pieces cross words: {crossing[:5]}")
    return spark.createDataFrame(rows, PIECES)


def word_pattern(pieces: DataFrame) -> str:
    """The finest cut into words that no piece of the vocabulary crosses."""
    return _WORD if pieces.where("kind = 'normal'").where(F.rlike("piece", F.lit("\\p{L}[^\\p{L}]"))).head(1) else _LETTERS


def words_in(text: Column, pattern: str = _WORD) -> Column:
    """The words of a text in the model's alphabet: spaces are marked, one is put in front; an empty text has none."""
    marked = F.concat(F.lit(SPACE), F.replace(text, F.lit(" "), F.lit(SPACE)))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.regexp_extract_all(marked, F.lit(pattern), F.lit(0)))


def _merge(text: str, score: dict[str, float]) -> list[str]:
    """Best-scored neighbours first, leftmost of equals, until no neighbours form a piece."""
    parts = list(text)
    while True:
        best, at = None, -1
        for i in range(len(parts) - 1):
            s = score.get(parts[i] + parts[i + 1])
            if s is not None and (best is None or s > best):
                best, at = s, i
        if best is None:
            return parts
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


def _steps(score: dict[str, float]):
    """Keeps the edges of a word that merges make and adds to each the pieces that may stand before it.

    Merges give one result, so one path from the beginning to the end has only neighbours that stay apart. It is looked
    for from the beginning, so that only pairs on the way are compared, not all pairs of the lattice.
    """

    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        alone: dict[str, bool] = {}
        pairs: dict[tuple[str, str], bool] = {}

        def stays(p: str) -> bool:
            known = alone.get(p)
            if known is None:
                known = alone[p] = _merge(p, score) == [p]
            return known

        def fits(a: str, b: str) -> bool:
            known = pairs.get((a, b))
            if known is None:
                if len(pairs) >= 2_000_000:
                    pairs.clear()
                known = pairs[a, b] = _merge(a + b, score) == [a, b]
            return known

        def path(word: str, starts: list[int], ends: list[int], ids: list[int]) -> list[int]:
            """Numbers of the edges of the one path whose neighbours all fit; longer pieces are tried first."""
            after: dict[int, list[int]] = {}
            for j, s in enumerate(starts):
                after.setdefault(s, []).append(j)
            # Edges still to be tried after each edge of the path; an edge that was left once leads nowhere.
            way, open_, tried = [], [after[0]], set()
            while open_:
                if open_[-1]:
                    j = open_[-1].pop()
                    piece = word[starts[j] : ends[j]]
                    # Nothing merges with the beginning or with a character outside the vocabulary.
                    free = not way or ids[j] < -1 or ids[way[-1]] < -1
                    if j in tried or ids[j] >= 0 and not stays(piece) or not (free or fits(word[starts[way[-1]] : ends[way[-1]]], piece)):
                        continue
                    tried.add(j)
                    way.append(j)
                    if ends[j] == len(word):
                        return way
                    open_.append(list(after[ends[j]]))
                else:
                    open_.pop()
                    if way:
                        way.pop()
            return []

        for columns in batches:
            keep, before = [], []
            for word, starts, ends, ids in zip(*columns):
                names = ids.tolist()
                way = path(word, starts.tolist(), ends.tolist(), names)
                keep.append(way)
                before.append([[-1], *[[names[j]] for j in way[:-1]]] if way else [])
            yield pd.DataFrame({"keep": keep, "before": before})

    return F.pandas_udf(run, "keep array<int>, before array<array<int>>")


def _best_path(edges: Column, length: Column) -> Column:
    """Ids of the best path over edges (start, end, id, score, before) sorted by start; ties to smaller ids."""
    begin = F.array(
        F.struct(F.lit(0).alias("end"), F.lit(-1).alias("id"), F.lit(0.0).alias("score"), F.array().cast("array<int>").alias("path"))
    )

    def step(acc: Column, e: Column) -> Column:
        live = F.filter(acc, lambda a: a["end"] >= e["start"])
        fit = F.filter(acc, lambda a: (a["end"] == e["start"]) & (e["before"].isNull() | F.array_contains(e["before"], a["id"])))
        best = F.array_max(F.transform(fit, lambda a: F.struct(a["score"].alias("score"), a["path"].alias("path"))))
        more = F.struct(
            e["end"].alias("end"), e["id"].alias("id"), (best["score"] + e["score"]).alias("score"), F.concat(best["path"], F.array(e["id"])).alias("path")
        )
        return F.when(best.isNotNull(), F.concat(live, F.array(more))).otherwise(live)

    def end(acc: Column) -> Column:
        done = F.filter(acc, lambda a: a["end"] == length)
        return F.array_max(F.transform(done, lambda a: F.struct(a["score"].alias("score"), a["path"].alias("path"))))["path"]

    return F.aggregate(edges, begin, step, end)


def dictionary(words: DataFrame, pieces: DataFrame, merges: bool = True) -> DataFrame:
    """(word, ids) of distinct words. ``merges``: the model is one of merges; else the best sum of scores is taken."""
    longest = pieces.where("kind = 'normal'").agg(F.max(F.length("piece"))).first()[0] or 1
    normal = F.broadcast(pieces.where("kind = 'normal'").select(F.col("piece").alias("part"), "id", "score"))
    low = float(pieces.agg(F.min("score")).first()[0] or 0.0) - 10.0
    first_byte = pieces.where("kind = 'byte'").agg(F.min("id")).first()[0]
    # Slices that overlap by the longest piece, so that a substring is not searched from the beginning of a long word.
    begins = F.sequence(F.lit(0), F.length("word") - 1, F.lit(SLICE))
    tasks = -(-words.count() // WORDS_PER_TASK) or 1
    slices = words.select("word").repartition(tasks, "word").select("word", F.explode(begins).alias("base"))
    slices = slices.select("word", "base", F.substr("word", F.col("base") + 1, F.lit(SLICE + longest - 1)).alias("slice"))
    starts = F.sequence(F.lit(0), F.least(F.lit(SLICE), F.length("slice")) - 1)
    places = slices.select("word", "base", "slice", F.explode(starts).alias("s"))
    sizes = F.sequence(F.lit(1), F.least(F.lit(longest), F.length("slice") - F.col("s")))
    sized = places.select("word", "base", "s", "slice", F.explode(sizes).alias("n"))
    parts = sized.select("word", "base", "s", F.substr("slice", F.col("s") + 1, F.col("n")).alias("part"))
    found = parts.join(normal, "part", "left").where("id IS NOT NULL OR length(part) = 1")
    edge = F.struct(
        (F.col("base") + F.col("s")).alias("start"), (F.col("base") + F.col("s") + F.length("part")).alias("end"),
        F.coalesce(F.col("id"), OUTSIDE - F.col("base") - F.col("s")).alias("id"), F.coalesce("score", F.lit(low)).alias("score"),
    )
    grouped = found.groupBy("word").agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    if merges:
        score = {r.piece: r.score for r in pieces.where("kind = 'normal'").select("piece", "score").toLocalIterator()}
        steps = _steps(score)("word", "edges.start", "edges.end", "edges.id")
        both = grouped.select("word", "edges", steps.alias("steps"))
        edges = F.zip_with("steps.keep", "steps.before", lambda k, b: F.get(F.col("edges"), k).withField("before", b))
        grouped = both.select("word", edges.alias("edges"))
    else:
        none = F.lit(None).cast("array<int>")
        grouped = grouped.select("word", F.transform("edges", lambda e: e.withField("before", none)).alias("edges"))
    found = grouped.select("word", _best_path(F.col("edges"), F.length("word")).alias("path"))
    if first_byte is None:
        instead = pieces.where("kind = 'special'").agg(F.min("id")).first()[0]
        other = lambda x: F.array(F.lit(instead))
    else:

        def other(x: Column) -> Column:
            utf8 = F.hex(F.encode(F.substr("word", OUTSIDE - x + 1, F.lit(1)), "UTF-8"))
            places = F.sequence(F.lit(1), F.length(utf8), F.lit(2))
            return F.transform(places, lambda i: F.conv(F.substr(utf8, i, F.lit(2)), 16, 10).cast("int") + first_byte)

    whole = F.flatten(F.transform("path", lambda x: F.when(x >= 0, F.array(x)).otherwise(other(x))))
    plain = F.forall("path", lambda x: x >= 0)
    return found.select("word", F.when(plain, F.col("path")).otherwise(whole).alias("ids"))


def hex_table(pieces: DataFrame) -> DataFrame:
    """One row: the bytes of every piece in hex, by id; as large as the vocabulary."""
    return pieces.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "hex"))), lambda x: x["hex"]).alias("hex"))


def decode(ids: Column, table: Column) -> Column:
    """Text of an array of ids, the marked space in front included."""
    return F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.get(table, i)), "")), "UTF-8")


def _staged_by_hash(known: DataFrame) -> DataFrame:
    """Written while the words of a task are grouped by hash: they fit into its memory, and need no sort of all edges."""
    conf, name = known.sparkSession.conf, "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = conf.get(name)
    conf.set(name, str(4 * WORDS_PER_TASK))
    try:
        return stage(known)
    finally:
        conf.set(name, before)


def encode(docs: DataFrame, pieces: DataFrame, merges: bool = True, hot: int = HOT_WORDS) -> DataFrame:
    """One row per word of every row of ``docs``: row, doc_id, at, word, ids, exact (the ids decode to the word).

    ``docs`` has doc_id and text (other columns are ignored) and is a stored table: ``row`` tells its rows apart, so
    that repeated ones are encoded each. A row of a null or empty text has one row with a null word. An empty table
    gives no rows.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words_in(whole_text(F.col("text")), word_pattern(pieces)).alias("words"))
    rows = rows.select("row", "doc_id", F.posexplode_outer("words").alias("at", "word"))
    counts = stage(rows.where("word IS NOT NULL").groupBy("word").agg(F.count("*").alias("n")))
    table = hex_table(pieces).scalar()
    known = dictionary(counts, pieces, merges).select("word", "ids", table.alias("_h"))
    exact = decode(F.col("ids"), F.col("_h")) == F.replace("word", F.lit(SPACE), F.lit(" "))
    known = _staged_by_hash(known.select("word", "ids", F.coalesce(exact, F.lit(False)).alias("exact")))
    if counts.limit(hot + 1).count() <= hot:
        return rows.join(F.broadcast(known), "word", "left").select("row", "doc_id", "at", "word", "ids", "exact")
    frequent = stage(counts.orderBy(F.desc("n"), "word").limit(hot).select("word"))
    front = stage(known.join(F.broadcast(frequent), "word"))
    rest = known.join(F.broadcast(frequent), "word", "left_anti").withColumn("ids2", F.col("ids")).select("word", F.col("ids2").alias("ids"), "exact")
    hit = F.broadcast(front.withColumn("hit", F.lit(True)))
    first = rows.join(hit, "word", "left").where("hit OR word IS NULL").select("row", "doc_id", "at", "word", "ids", "exact")
    other = rows.where("word IS NOT NULL").join(F.broadcast(frequent), "word", "left_anti").join(rest.hint("merge"), "word")
    return first.unionByName(other.select("row", "doc_id", "at", "word", "ids", "exact"))


def assemble(encoded: DataFrame) -> DataFrame:
    """(row, doc_id, ids) with the whole array of ids of every row; one row's ids must fit into a task."""
    pairs = F.collect_list(F.when(F.col("ids").isNotNull(), F.struct("at", "ids")))
    joined = F.flatten(F.transform(F.array_sort(pairs), lambda x: x["ids"]))
    return encoded.groupBy("row").agg(F.any_value("doc_id").alias("doc_id"), joined.alias("ids"))


def summarise(encoded: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_pieces, ids_xor (of hashes of place and ids) and exact (all words decode to themselves)."""
    size = F.coalesce(F.size("ids"), F.lit(0))
    return (
        encoded.groupBy("row")
        .agg(
            F.any_value("doc_id").alias("doc_id"), F.count("word").alias("n_words"),
            F.sum(F.when(F.col("ids").isNotNull(), size).otherwise(0)).cast("long").alias("n_pieces"),
            F.bit_xor(F.when(F.col("word").isNotNull(), F.xxhash64("at", "ids")).otherwise(F.lit(0).cast("long"))).alias("ids_xor"),
            F.min(F.coalesce("exact", F.lit(True))).alias("exact"),
        )
        .drop("row")
    )
