"""Text functions: trigrams, normalisation, expansion, chunks, summaries and passages."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from recallum.functions import rulesets
from recallum.sources.shared import against
from recallum.sources.tables import tokens


def trigrams(text: Column) -> Column:
    """Distinct trigrams of all words, each padded by two blanks before and one behind."""
    grams = F.transform(tokens(text), lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams of the two texts; 0 if neither has any."""
    x, y = trigrams(a), trigrams(b)
    return F.coalesce(F.size(F.array_intersect(x, y)) / F.nullif(F.size(F.array_union(x, y)), F.lit(0)), F.lit(0.0))


def normalise_space(text: Column) -> Column:
    """Unix line ends, single blanks, at most one empty line, trimmed."""
    t = F.regexp_replace(text, "\r\n?", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(t, "[ \t ]+", " "), "\n{3,}", "\n\n"))


def canonical_id(raw: Column) -> Column:
    """`#12`, `12`, `v12`, `l12`, `tv12` → `v12`; `vmi<id>`, `tm<id>`, `m<id>`, long bare ids → `vmi<id>`."""
    t = F.trim(raw)
    number = F.regexp_extract(t, r"^(?:#|tv|t|v|l)?(\d+)$", 1)
    item = F.regexp_extract(t, r"^(?:vmi|tm|mt|m)(.+)$", 1)
    return F.when(number != "", F.concat(F.lit("v"), number)).when(item != "", F.concat(F.lit("vmi"), item)).when(F.length(t) >= 20, F.concat(F.lit("vmi"), t))


def expand_terms(queries: DataFrame, variants: DataFrame, least: int = 4, synonyms: DataFrame | None = None, unexpanded: list[str] = rulesets.UNEXPANDED) -> DataFrame:
    """(qid, terms) and (root, variant) → (qid, term): the terms; variants of roots that equal a term; those of roots of `least` characters that contain a longer term, or are contained in it, unless it is a stopword; synonyms (root, variant) of terms."""
    terms = queries.select("qid", F.explode("terms").alias("term"))
    equal = terms.join(variants.unionByName(synonyms) if synonyms is not None else variants, F.col("term") == F.col("root")).select("qid", "variant")
    open_ = terms.where((F.length("term") >= least) & ~F.col("term").isin(unexpanded))
    far = against(open_, variants.where(F.length("root") >= least), F.col("term").contains(F.col("root")) | F.col("root").contains(F.col("term")), "root").select("qid", "variant")
    return terms.union(equal).union(far).distinct()


def fixed_variants(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The fixed (root, variant) tables: stems, and general synonyms."""
    table = lambda of: spark.createDataFrame([(r, v) for r, vs in of.items() for v in vs], "root string, variant string")
    return table(rulesets.STEMS), table(rulesets.SYNONYMS)


def contains_any(text: Column, terms: Column) -> Column:
    low = F.lower(text)
    return F.exists(terms, lambda t: F.contains(low, t))


def matched(text: Column, terms: Column) -> Column:
    """How many of the terms occur in the text, as substrings."""
    low = F.lower(text)
    return F.size(F.filter(terms, lambda t: F.contains(low, t)))


def proximity(text: Column, terms: Column) -> Column:
    """Bonus by the span of the terms' first places: 30 up to 150 characters, 20 up to 350, 8 up to 700; two terms at least."""
    low = F.lower(text)
    at = F.filter(F.transform(terms, lambda t: F.instr(low, t)), lambda p: p > 0)
    span = F.array_max(at) - F.array_min(at)
    full = F.size(at) == F.size(terms)
    return F.when(F.size(at) < 2, 0).when(full & (span <= 150), 30).when(full & (span <= 350), 20).when(full & (span <= 700), 8).when(span <= 150, 10).otherwise(0)


def proximity_bonus(found: Column, terms: Column, span: Column) -> Column:
    """`proximity` from the number of terms found, of all terms, and the span of their first places."""
    full = found == terms
    return F.when(found < 2, 0).when(full & (span <= 150), 30).when(full & (span <= 350), 20).when(full & (span <= 700), 8).when(span <= 150, 10).otherwise(0)


def mention_penalty(score: Column, text: Column, phrase: Column) -> Column:
    """Score times 0.45 where every occurrence of the phrase in the text stands in quotes, backticks or asterisks."""
    low, p = F.lower(text), F.lower(phrase)
    escaped = F.regexp_replace(p, r"([^\p{L}\p{N}\s_])", r"\\$1")
    every = F.size(F.regexp_extract_all(low, escaped, F.lit(0)))
    quoted = F.size(F.regexp_extract_all(low, F.concat(F.lit("[\"'`*«“]"), escaped, F.lit("[\"'`*»”]")), F.lit(0)))
    return F.when((every > 0) & (every == quoted) & p.contains(" "), F.round(score * 0.45, 4)).otherwise(score)


def summarise(text: Column, most: int = 600) -> Column:
    """Whole text if it has at most `most` characters; else its leading lines of that many, else its leading sentences, else its begin, with an ellipsis."""
    head = F.substring(text, 1, most)
    leading = lambda pattern: F.nullif(F.regexp_replace(F.regexp_extract(head, pattern, 0), r"^\s+|\s+$", ""), F.lit(""))
    short = F.coalesce(leading(r"(?s)^.*\n"), leading(r"(?s)^.*[.!?] "), F.substring(text, 1, most - 1))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(short, F.lit("…")))


def sql_summary(text: str, most: int = 600) -> str:
    """`summarise` for DuckDB."""
    leading = lambda pattern: f"nullif(regexp_replace(regexp_extract({text}[1:{most}], '{pattern}'), '^\\s+|\\s+$', '', 'g'), '')"
    return f"CASE WHEN length({text}) <= {most} THEN {text} ELSE coalesce({leading('(?s)^.*' + chr(92) + 'n')}, {leading('(?s)^.*[.!?] ')}, {text}[1:{most - 1}]) || '…' END"


def split_chunks(text: str | None, most: int = 1800, overlap: int = 180, least: int = 200) -> list[str]:
    """Pieces of at most `most` characters cut at paragraphs, then sentences, then anywhere; small ones are joined to the one before; each but the first repeats the last `overlap` characters."""
    if not text:
        return []
    pieces: list[str] = []
    for part in (p for para in text.split("\n") for p in ([para] if len(para) <= most else re.split(r"(?<=[.!?]) ", para))):
        for k in range(0, max(1, len(part)), most):
            bit = part[k : k + most]
            if pieces and len(pieces[-1]) + 1 + len(bit) <= most:
                pieces[-1] += "\n" + bit
            else:
                pieces.append(bit)
    if len(pieces) > 1 and len(pieces[-1]) < least:
        last = pieces.pop()
        pieces[-1] += "\n" + last
    return [p if k == 0 else pieces[k - 1][-overlap:] + p for k, p in enumerate(pieces)]


def chunk(df: DataFrame, id_col: str, text_col: str, most: int = 1800, overlap: int = 180) -> DataFrame:
    """→ (id, chunk_index, content)."""

    @F.pandas_udf("array<string>")
    def run(t: pd.Series) -> pd.Series:
        return t.map(lambda x: split_chunks(x, most, overlap))

    return df.select(F.col(id_col).alias("id"), F.posexplode(run(F.col(text_col))).alias("chunk_index", "content"))


# Lines that begin a definition, by language; the least lines of a block, the lines of a plain one, the least and the most characters.
DEFINITIONS = {
    "php": r"^\s*(?:function|class|interface|trait|enum)\s",
    "python": r"^\s*(?:def |class |async def )",
    "javascript": r"^\s*(?:function |class |const .* = .*=>|async function)",
    "typescript": r"^\s*(?:function |class |interface |type |const .* = .*=>|async function)",
}
LEAST_LINES, PLAIN_LINES, LEAST_CHARS, MOST_CHARS = 3, 200, 20, 50_000


def code_blocks(text: str | None, language: str | None) -> list[tuple[int, int, str]]:
    """(first line, last line, content) of a file's chunks.

    In the four languages of DEFINITIONS a chunk goes from one definition line to the next; shorter ones than
    LEAST_LINES are left out, but for the last, which goes to the chunk before.  Other files are cut every PLAIN_LINES lines.
    """
    lines = (text or "").replace("\r\n", "\n").replace("\r", "\n").split("\n")
    lines = lines[:-1] if lines[-1] == "" else lines
    if language in DEFINITIONS:
        begins = re.compile(DEFINITIONS[language])
        cut = [0, *(k for k, r in enumerate(lines) if k and begins.match(r + "\n"))]
        spans = list(zip(cut, [*cut[1:], len(lines)], strict=True))
        blocks = [[a, b, lines[a:b]] for a, b in spans if b - a >= LEAST_LINES]
        a, b = spans[-1]
        if blocks and b - a < LEAST_LINES:
            blocks[-1][1:] = [b, blocks[-1][2] + lines[a:b]]
    else:
        blocks = [[a, min(a + PLAIN_LINES, len(lines)), lines[a : a + PLAIN_LINES]] for a in range(0, len(lines), PLAIN_LINES)]
    found = [(a + 1, b, "\n".join(part).strip()) for a, b, part in blocks]
    return [(a, b, c[:MOST_CHARS]) for a, b, c in found if len(c) >= LEAST_CHARS]


def code_chunks(df: DataFrame, id_col: str, text_col: str, language: Column | None = None) -> DataFrame:
    """→ (id, chunk_index, line_start, line_end, content, digest): `code_blocks` of each file; without a language, plain blocks of lines."""

    @F.pandas_udf("array<struct<line_start:int,line_end:int,content:string>>")
    def run(t: pd.Series, of: pd.Series) -> pd.Series:
        return pd.Series([[{"line_start": a, "line_end": b, "content": c} for a, b, c in code_blocks(x, y)] for x, y in zip(t, of, strict=True)])

    of = F.lit(None).cast("string") if language is None else language
    got = df.select(F.col(id_col).alias("id"), F.posexplode(run(F.col(text_col), of)).alias("chunk_index", "c"))
    return got.select("id", "chunk_index", "c.line_start", "c.line_end", "c.content", F.md5("c.content").alias("digest"))


def best_passage(df: DataFrame, text_col: str, terms_col: str, window: int = 700, step: int = 600) -> DataFrame:
    """Adds (passage, coverage): the paragraph window with the largest share of the terms, the first of equals."""

    @F.pandas_udf("struct<passage:string,coverage:double>")
    def run(t: pd.Series, terms: pd.Series) -> pd.DataFrame:
        def one(text: str | None, want: object) -> tuple[str, float]:
            best, share = "", -1.0
            for para in (text or "").split("\n"):
                for k in range(0, max(1, len(para)), step):
                    part = para[k : k + window]
                    low = part.lower()
                    s = sum(w in low for w in want) / max(1, len(want))
                    if s > share:
                        best, share = part, s
            return best, max(share, 0.0)

        rows = [one(a, b if b is not None else []) for a, b in zip(t, terms, strict=True)]
        return pd.DataFrame(rows, columns=["passage", "coverage"])

    return df.withColumn("p", run(F.col(text_col), F.col(terms_col))).withColumns({"passage": F.col("p.passage"), "coverage": F.col("p.coverage")}).drop("p")


def compress(text: Column, terms: Column, ratio: float = 0.3) -> Column:
    """The best share of sentences by term hits (half a point for the first), in their order."""
    parts = F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s, i: F.struct((F.size(F.filter(terms, lambda t: F.contains(F.lower(s), t))) + F.when(i == 0, 0.5).otherwise(0.0)).alias("score"), (-i).alias("back"), s.alias("s")))
    keep = F.greatest(F.lit(1), F.floor(F.size(parts) * ratio).cast("int"))
    best = F.slice(F.reverse(F.array_sort(parts)), F.lit(1), keep)
    return F.array_join(F.transform(F.reverse(F.array_sort(F.transform(best, lambda x: F.struct(x["back"].alias("back"), x["s"].alias("s"))))), lambda x: x["s"]), " ")
