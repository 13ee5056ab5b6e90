"""Text ETL: blocks to sections to chunks. Order is carried in columns; folds over one text are column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import noise_fraction

# Heading and section patterns and names.
HEADING = r"^(?:\d{1,2}(?:\.\d{1,2}){0,2}\.?|[IVX]{1,4}\.)\s+[A-Z][\p{L}\p{N}_\s,:\-–()/']{3,80}$"
NUMBER_PREFIX = r"^(?:\d{1,2}(?:\.\d{1,2}){0,2}\.?|[IVX]{1,4}\.)\s+"
NAMED = (
    "abstract", "introduction", "methods", "method", "data", "observations", "results", "discussion", "conclusions", "conclusion", "summary",
    "acknowledgements", "acknowledgments", "references", "bibliography", "appendix",
)
STOP = ("references", "bibliography", "acknowledgements", "acknowledgments")
FRONT = "Front matter"
MAX_CHARS, OVERLAP, MIN_CHARS, LONG_CHUNK = 1800, 200, 200, 500
NOISE_LIMIT = 0.25
HELD_CHARS = 1 << 22  # of sections that a worker holds before they leave

EDGE = r"(?U)^\s+|\s+$"


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, EDGE, "")


def dehyphenated(text: Column) -> Column:
    """A word cut at a line's end is joined before a lower-case letter; other line ends, with the white space around them, become one blank."""
    return F.regexp_replace(F.regexp_replace(text, r"-\n(?=[a-z])", ""), r"(?U)\s*\n\s*", " ")


def clean_name(block: Column) -> Column:
    """A heading without its number and closing marks."""
    return stripped(F.regexp_replace(F.regexp_replace(stripped(block), NUMBER_PREFIX, ""), r"^[. :]+|[. :]+$", ""))


def is_heading(block: Column) -> Column:
    """One line of at most 90 characters that bears a known name or a section number."""
    return ~F.contains(block, F.lit("\n")) & (F.length(block) <= 90) & (F.lower(clean_name(block)).isin(*NAMED) | block.rlike(HEADING))


def sections(blocks: DataFrame) -> DataFrame:
    """blocks (paper_id, block_no, text) -> (paper_id, section_no, section, text).

    A block belongs to the last heading before it; a stop heading ends the paper; sections without text drop out.
    """
    line = W.partitionBy("paper_id").orderBy("block_no").rowsBetween(W.unboundedPreceding, 0)
    marked = blocks.withColumn("text", stripped("text")).where("text <> ''").withColumn("_heading", is_heading(F.col("text"))).withColumn("_name", F.when(F.col("_heading"), clean_name(F.col("text"))))
    running = marked.withColumn("section_no", F.sum(F.col("_heading").cast("int")).over(line)).withColumn("_stopped", F.max(F.lower("_name").isin(*STOP)).over(line))
    named = running.withColumn("section", F.coalesce(F.last(F.when(F.col("_name") != "", F.col("_name")).otherwise(F.when(F.col("_heading"), F.col("text"))), ignorenulls=True).over(line), F.lit(FRONT)))
    body = named.where(~F.coalesce("_stopped", F.lit(False)) & ~F.col("_heading"))
    whole = F.sort_array(F.collect_list(F.struct("block_no", "text")))
    return body.groupBy("paper_id", "section_no", "section").agg(F.array_join(F.transform(whole, lambda b: b["text"]), "\n\n").alias("text"))


def with_abstract(found: DataFrame, metadata: DataFrame) -> DataFrame:
    """The metadata's abstract as section -1; parsed front matter and abstract give way."""
    own = metadata.select("paper_id", F.lit(-1).cast("long").alias("section_no"), F.lit("Abstract").alias("section"), F.col("abstract").alias("text"))
    rest = found.where(~F.col("section").isin(FRONT, "Abstract"))
    return own.unionByName(rest.select(*own.columns))


def hard_split(paragraph: Column, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> Column:
    """Pieces of a paragraph over ``max_chars``: a cut falls on the last blank of the window's second half, the next piece
    starts ``overlap`` characters before the cut. A fold whose number of steps is bounded by the paragraph's length."""
    n, half = F.length(paragraph), max_chars // 2
    least_step = max(1, half - overlap)
    steps = F.sequence(F.lit(0), F.floor(n / least_step).cast("int"))

    def step(state: Column, _: Column) -> Column:
        start = state["start"]
        limit = F.least(start + max_chars, n)
        # the last blank at or after start + half and before the limit
        window = F.substring(paragraph, start + half + 1, F.greatest(limit - start - half, F.lit(0)))
        back = F.instr(F.reverse(window), F.lit(" "))
        end = F.when((limit < n) & (back > 0), limit - back).otherwise(limit)
        piece = stripped(F.substring(paragraph, start + 1, end - start))
        after = F.when(end >= n, n).otherwise(F.greatest(end - overlap, start + 1)).cast("int")
        grown = F.when(piece != "", F.concat(state["out"], F.array(piece))).otherwise(state["out"])
        return F.when(start >= n, state).otherwise(F.struct(after.alias("start"), grown.alias("out")))

    first = F.struct(F.lit(0).alias("start"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(steps, first, step, lambda state: state["out"])


def packed(text: Column, paragraph_break: str = r"\n{2,}", max_chars: int = MAX_CHARS, overlap: int = OVERLAP, min_chars: int = MIN_CHARS) -> Column:
    """Chunks of a section: paragraphs (hard-split where too long) are packed greedily; a short last chunk joins the one before."""
    paragraphs = F.filter(F.transform(F.split(text, paragraph_break), stripped), lambda p: p != "")
    pieces = F.flatten(F.transform(paragraphs, lambda p: F.when(F.length(p) > max_chars, hard_split(p, max_chars, overlap)).otherwise(F.array(p))))

    def step(state: Column, piece: Column) -> Column:
        full = (state["cur"] != "") & (F.length(state["cur"]) + F.length(piece) + 2 > max_chars)
        joined = F.when(state["cur"] == "", piece).otherwise(F.concat(state["cur"], F.lit("\n\n"), piece))
        return F.struct(
            F.when(full, F.concat(state["out"], F.array(state["cur"]))).otherwise(state["out"]).alias("out"), F.when(full, piece).otherwise(joined).alias("cur")
        )

    def close(state: Column) -> Column:
        done = F.when(state["cur"] != "", F.concat(state["out"], F.array(state["cur"]))).otherwise(state["out"])
        n, last = F.size(done), F.element_at(done, -1)
        short = (n > 1) & (F.length(F.get(done, n - 1)) < min_chars)
        merged = F.concat(F.slice(done, 1, F.greatest(n - 2, F.lit(0))), F.array(F.concat(F.get(done, n - 2), F.lit("\n\n"), last)))
        return F.when(short, merged).otherwise(done)

    first = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))
    return F.aggregate(pieces, first, step, close)


def build_chunks(found: DataFrame, titles: DataFrame, paragraph_break: str = r"\n{2,}", max_chars: int = MAX_CHARS) -> DataFrame:
    """sections -> (paper_id, chunk_no, chunk_id, title, section, text); numbers run on through a paper's sections."""
    pieces = found.select("paper_id", "section_no", "section", F.posexplode(packed(F.col("text"), paragraph_break, max_chars)).alias("pos", "text"))
    number = F.row_number().over(W.partitionBy("paper_id").orderBy("section_no", "pos")) - 1
    numbered = pieces.withColumn("chunk_no", number.cast("long")).withColumn("chunk_id", F.concat("paper_id", F.lit("::"), "chunk_no"))
    return numbered.join(titles, "paper_id", "left").select("paper_id", "chunk_no", "chunk_id", "title", "section", "text")


def parse_records(records: DataFrame, files: DataFrame, extract: Callable[[str], list[tuple[str, str]]]) -> tuple[DataFrame, DataFrame]:
    """records (paper_id, abstract) and files (paper_id, content) -> (sections, failures (paper_id, reason)).

    ``extract`` is pluggable Python that gives the (section, text) pairs of one file; what it raises becomes the record's
    reason, and a record without a file fails as such. The metadata's abstract replaces parsed front matter and abstract.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = lambda rows: pd.DataFrame(rows, columns=["paper_id", "section_no", "section", "text", "reason"])
        for pdf in batches:
            out: list[tuple] = []
            held = 0
            for paper, content in zip(pdf.paper_id, pdf.content, strict=True):
                if held > HELD_CHARS:  # sections leave in pieces, however many files come at once
                    yield made(out)
                    out, held = [], 0
                if content is None:
                    out.append((paper, None, None, None, "no file found"))
                    continue
                try:
                    found = [(paper, i, name, text, None) for i, (name, text) in enumerate(extract(content))]
                except Exception as error:  # any fault of one file is that record's failure, not the run's
                    found = [(paper, None, None, None, str(error))]
                out += found or [(paper, None, None, None, None)]
                held += sum(len(row[3] or "") for row in found)
            yield made(out)

    kind = dict(records.dtypes)["paper_id"]
    parsed = records.select("paper_id").join(files.select("paper_id", "content"), "paper_id", "left").mapInPandas(run, f"paper_id {kind}, section_no long, section string, text string, reason string")
    failures = parsed.where("reason is not null").select("paper_id", "reason")
    sound = records.join(failures.select("paper_id"), "paper_id", "left_anti")
    return with_abstract(parsed.where("section is not null").select("paper_id", "section_no", "section", "text"), sound), failures


def corpus_summary(papers: DataFrame, chunks: DataFrame, split: Column, top: int = 6) -> DataFrame:
    """One row about papers (paper_id, published) and chunks: counts, time span in days, papers and long chunks of the test split,
    the most frequent sections of long chunks, and warnings where the corpus is too small, short or lopsided for a benchmark."""
    day = F.to_date(F.substring("published", 1, 10))
    own = papers.select("paper_id", day.alias("d"), split.alias("split"))
    p = own.agg(F.count("*").alias("papers"), F.min("d").alias("first_day"), F.max("d").alias("last_day"), F.count_if(F.col("split") == "test").alias("test_papers"))
    year = own.groupBy(F.year("d").alias("y")).agg(F.count("*").alias("n")).agg(F.max("n").alias("most_of_a_year"))
    long = F.length("text") >= LONG_CHUNK
    c = chunks.agg(F.count("*").alias("chunks"), F.count_if(long).alias("long_chunks"), F.count_if(long & (split == "test")).alias("long_test_chunks"))
    best = chunks.where(long).groupBy("section").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "section").limit(top)
    named = F.struct((-F.col("n")).alias("n"), "section", F.concat("section", F.lit(":"), "n").alias("line"))
    s = best.agg(F.array_join(F.transform(F.sort_array(F.collect_list(named)), lambda x: x["line"]), " ").alias("top_sections"))
    met = p.crossJoin(year).crossJoin(c).crossJoin(s).withColumn("span_days", F.datediff("last_day", "first_day"))  # one-row tables
    warn = F.array(
        F.when(F.col("test_papers") < 25, "few_test_papers"), F.when(F.col("span_days") < 365, "short_span"), F.when(F.col("most_of_a_year") > 0.6 * F.col("papers"), "one_year_dominates"),
    )
    return met.withColumn("warnings", F.array_join(F.filter(warn, lambda w: w.isNotNull()), ","))


def noisy_gold(questions: DataFrame, chunks: DataFrame, limit: float = NOISE_LIMIT) -> DataFrame:
    """(id, qtype, noise) of accepted questions whose noisiest gold chunk reaches the limit; a chunk that is missing has no noise."""
    wanted = questions.where(F.col("status") == "accepted").select("id", "qtype", F.explode("gold_chunk_ids").alias("chunk_id"))
    met = wanted.join(chunks.select("chunk_id", noise_fraction(F.col("text")).alias("noise")), "chunk_id", "left")
    most = met.groupBy("id", "qtype").agg(F.round(F.max(F.coalesce("noise", F.lit(0.0))), 2).alias("noise"))
    return most.where(F.col("noise") >= limit)


def parse_failures(records: DataFrame, texts: DataFrame) -> DataFrame:
    """(paper_id, reason) of records whose text is missing or empty: what stands against publishing an index. One row a record,
    however many texts it has; only what is known of a text travels."""
    own = texts.where("text is not null").groupBy("paper_id").agg(F.bool_and(stripped(F.col("text")) == "").alias("blank"))
    met = records.select("paper_id").join(own, "paper_id", "left")
    reason = F.when(F.col("blank").isNull(), "missing").when(F.col("blank"), "empty")
    return met.select("paper_id", reason.alias("reason")).where("reason is not null")


def html_blocks(pages: DataFrame) -> DataFrame:
    """pages (paper_id, html) -> (paper_id, block_no, text): headings, paragraphs and list items without markup."""
    body = F.regexp_replace("html", r"(?is)<(script|style|nav)\b.*?</\1>|<!--.*?-->", "")
    found = F.regexp_extract_all(body, F.lit(r"(?is)<(?:h[1-6]|p|li)\b[^>]*>(.*?)(?=</?(?:h[1-6]|p|li|ul|ol|article|div|body|html)\b|$)"), F.lit(1))
    text = F.regexp_replace(F.col("raw"), r"(?s)<[^>]*>", "")
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return pages.select("paper_id", F.posexplode(found).alias("block_no", "raw")).select("paper_id", F.col("block_no").cast("long").alias("block_no"), dehyphenated(stripped(text)).alias("text")).where("text <> ''")
