"""Text operators: lines, tokens, phrases, mentions, chunks, HTML, redaction, fuzzy names."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 4000


def lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_no from 1, txt): text cut at line feeds, empty lines included."""
    return docs.select(key, F.posexplode(F.split(text, "\n", -1)).alias("_at", "txt")).select(key, (F.col("_at") + 1).cast("long").alias("line_no"), "txt")


def tokens(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pos from 1, token): lower-case runs of a-z and digits."""
    return docs.select(key, F.posexplode(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))).alias("_at", "token")).select(
        key, (F.col("_at") + 1).cast("long").alias("pos"), "token"
    )


def phrase_hits(index: DataFrame, key: str, words: list[str]) -> DataFrame:
    """(key, pos) of every place where the words follow one another.

    Only postings of the phrase's words leave the index; each votes for the place where the phrase would begin, so any
    phrase takes one aggregation.
    """
    votes = None
    for n, w in enumerate(words):
        own = index.filter(F.col("token") == w).select(key, (F.col("pos") - n).alias("pos"), F.lit(n).alias("_n"))
        votes = own if votes is None else votes.unionByName(own)
    return votes.groupBy(key, "pos").agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") == len(words)).select(key, "pos")


def mentions(docs: DataFrame, key: str, terms: DataFrame, term_key: str, text: str = "text") -> DataFrame:
    """(key, term_key): documents whose text contains a term's text (Q33).

    A contained term of five words or more has its second to fourth word whole in the document, so candidates are found
    by an equi-join on these and then tested by ``contains``. Terms with fewer words need a test against every
    document; they are sent along as one array, and their number is checked.
    """
    split = F.split(F.trim(F.regexp_replace("term", "[ \t\r\n]+", " ")), " ")
    long_terms = terms.select(term_key, F.col(text).alias("term")).withColumn("_w", split)
    keyed = long_terms.filter(F.size("_w") >= 5).select(term_key, "term", F.xxhash64(F.slice("_w", 2, 3)).alias("_k"))
    words = F.split(F.regexp_replace(text, "[ \t\r\n]+", " "), " ")
    grams = docs.select(key, words.alias("_d")).select(
        key, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size("_d") - 2, F.lit(1))), lambda i: F.xxhash64(F.slice("_d", i, 3))))).alias("_k")
    )
    candidates = grams.join(keyed, "_k").select(key, term_key).distinct()
    checked = (
        candidates.join(docs.select(key, F.col(text).alias("_text")), key)
        .join(long_terms.select(term_key, "term"), term_key)
        .filter(F.contains("_text", "term"))
        .select(key, term_key)
    )
    short = long_terms.filter((F.size("_w") < 5) & (F.length("term") > 0)).select(term_key, "term").limit(10_001).collect()
    if len(short) > 10_000:
        raise ValueError("more than 10,000 terms of under five words")
    if not short:
        return checked
    array = F.array(*[F.struct(F.lit(r[0]).alias("k"), F.lit(r[1]).alias("t")) for r in short])
    found = docs.select(key, F.explode(F.filter(array, lambda s: F.contains(F.col(text), s["t"]))).alias("s")).select(key, F.col("s.k").alias(term_key))
    return checked.unionByName(found)


def cut_section(text: str, limit: int = CHUNK) -> list[str]:
    """Pieces of at most ``limit`` characters: at blank lines, then line breaks, then sentence ends, then anywhere."""
    if len(text) <= limit:
        return [text]
    for sep in ("\n\n", "\n", ". "):
        parts = text.split(sep)
        if len(parts) > 1:
            out: list[str] = []
            for n, part in enumerate(parts):
                part = part + sep if n < len(parts) - 1 else part
                if out and len(out[-1]) + len(part) <= limit:
                    out[-1] += part
                else:
                    out.append(part)
            if max(map(len, out)) < len(text):
                return [piece for part in out for piece in (cut_section(part, limit) if len(part) > limit else [part]) if piece]
    return [text[i : i + limit] for i in range(0, len(text), limit)]


def chunks(docs: DataFrame, key: str, text: str = "text", limit: int = CHUNK) -> DataFrame:
    """(key, part, parts, chunk): the pieces of each text in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, n, len(cut), c) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for cut in [cut_section(t or "", limit)] for n, c in enumerate(cut, 1)]
            kinds = (batch.schema.field(0).type, pa.int64(), pa.int64(), pa.string())
            yield pa.record_batch([pa.array([r[j] for r in rows], kinds[j]) for j in range(4)], [key, "part", "parts", "chunk"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, part bigint, parts bigint, chunk string")


def html_links(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, link_no, href) in the order of the page."""
    found = F.regexp_extract_all(F.col(html), F.lit('href="([^"]*)"'), F.lit(1))
    return pages.select(key, F.posexplode(found).alias("_at", "href")).select(key, (F.col("_at") + 1).cast("long").alias("link_no"), "href")


def html_text(html: str | Column) -> Column:
    """Text of a page: comments, script and style go with their content, tags leave a space, common entities are read."""
    x = F.col(html) if isinstance(html, str) else html
    # a block that is never closed would be looked for from each of its openings: from the last closing tag on none is
    for opening, closing in (("<!--", "-->"), ("<script", "</script>"), ("<style", "</style>")):
        tail = r"<!--.*?-->" if opening == "<!--" else f"{opening}[^>]*>.*?{closing}"
        last = F.length(x) - F.locate(closing[::-1], F.reverse(F.lower(x))) + 1
        end = F.when(F.instr(F.lower(x), closing) > 0, last).otherwise(F.lit(0))
        x = F.concat(F.regexp_replace(F.substring(x, F.lit(1), end), f"(?is){tail}", " "), F.substring(x, end + 1, F.length(x)))
    x = F.regexp_replace(x, "<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(x, "[ \t\r\n]+", " "))


def redact(text: str | Column) -> Column:
    """E-mail addresses, paths and digits masked."""
    x = F.col(text) if isinstance(text, str) else text
    x = F.regexp_replace(x, "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", "<email>")
    x = F.regexp_replace(x, "(/[A-Za-z0-9._-]+){2,}", "<path>")
    return F.regexp_replace(x, "[0-9]+", "#")


def snap(pieces: DataFrame, vocabulary: DataFrame, most: int = 2) -> DataFrame:
    """(piece, word, distance): the one nearest known word of each piece, none if two are equally near (C14).

    Words are compared within blocks only: lengths at most one apart and the same first or last character, so the join is
    on (length, character) and not on all pairs.
    """
    p = pieces.select("piece").distinct()
    ends = lambda c: F.array(F.concat(F.lit("f"), F.substring(c, 1, 1)), F.concat(F.lit("l"), F.substring(c, -1, 1)))
    lengths = F.array(*[F.length("piece") + d for d in (-1, 0, 1)])
    left = p.select("piece", F.explode(ends("piece")).alias("_c")).select("piece", "_c", F.explode(lengths).alias("_n"))
    right = vocabulary.select("word").distinct().select("word", F.explode(ends("word")).alias("_c"), F.length("word").alias("_n"))
    near = left.join(right, ["_c", "_n"]).select("piece", "word").distinct().withColumn("distance", F.levenshtein("piece", "word").cast("long")).filter(F.col("distance") <= most)
    w = Window.partitionBy("piece").orderBy("distance", "word")
    ranked = near.withColumn("_r", F.row_number().over(w)).withColumn("_next", F.lead("distance").over(w))
    return ranked.filter((F.col("_r") == 1) & (F.col("_next").isNull() | (F.col("_next") > F.col("distance")))).select("piece", "word", "distance")


def snap_folded(pieces: DataFrame, vocabulary: DataFrame, least: float = 0.75, margin: float = 0.05) -> DataFrame:
    """(piece, word, likeness): as :func:`snap`, over names with look-alike characters folded, by likeness ``1 - distance / longer`` (C14).

    A word is taken if its likeness is ``least`` or more and no other is within ``margin`` of it.
    """
    from quernstone.operators.recovery import fold_glyphs

    ends = lambda c: F.array(F.concat(F.lit("f"), F.substring(c, 1, 1)), F.concat(F.lit("l"), F.substring(c, -1, 1)))
    left = pieces.select("piece").distinct().withColumn("a", fold_glyphs("piece"))
    left = left.select("piece", "a", F.explode(ends("a")).alias("c")).select("piece", "a", "c", F.explode(F.array(*[F.length("a") + d for d in (-1, 0, 1)])).alias("n"))
    right = vocabulary.select("word").distinct().withColumn("b", fold_glyphs("word"))
    right = right.select("word", "b", F.explode(ends("b")).alias("c"), F.length("b").alias("n"))
    like = F.lit(1.0) - F.levenshtein("a", "b") / F.greatest(F.length("a"), F.length("b"))
    near = left.join(right, ["c", "n"]).select("piece", "word", like.alias("likeness")).distinct().filter(F.col("likeness") >= least)
    w = Window.partitionBy("piece").orderBy(F.desc("likeness"), "word")
    ranked = near.withColumns({"place": F.row_number().over(w), "next": F.lead("likeness").over(w)})
    return ranked.filter((F.col("place") == 1) & (F.col("next").isNull() | (F.col("likeness") - F.col("next") >= margin))).select("piece", "word", "likeness")


def nearly_same(a: str | Column, b: str | Column) -> Column:
    """Whether two texts differ by at most max(6, 1 %) characters (C16); the bounded search stops early."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    most = F.greatest(F.lit(6), F.floor(F.greatest(F.length(x), F.length(y)) / 100).cast("int"))
    return F.when(F.abs(F.length(x) - F.length(y)) > most, F.lit(False)).otherwise(F.levenshtein(x, y) <= most)
