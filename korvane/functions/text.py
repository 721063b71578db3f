"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VALID_INTENTS = ("retrieve", "respond")
VALID_AGENTS = ("emotional_support", "rag_agent")
NODES_SHOWN = ("rag_agent", "emotional_support", "retrieve", "respond")
INTERNAL = "internal-llm"


def shown_to_user(node: Column, tags: Column, token: Column) -> Column:
    """Whether a token goes to the user: of a node that talks to them, not of an internal call, and not empty."""
    internal = F.coalesce(F.array_contains(tags, INTERNAL), F.lit(False))
    return node.isin(*NODES_SHOWN) & ~internal & (F.coalesce(token, F.lit("")) != "")


def normalize_output(text: Column) -> Column:
    """A model's one-word answer: white space and quotes around it go, letters become lower case."""
    return F.lower(F.regexp_replace(text, r"""^[\s"']+|[\s"']+$""", ""))


def intent_or_default(text: Column) -> Column:
    clean = normalize_output(text)
    return F.when(clean.isin(*VALID_INTENTS), clean).otherwise("retrieve")


def agent_or_error(text: Column) -> Column:
    clean = normalize_output(text)
    return F.when(clean.isin(*VALID_AGENTS), clean).otherwise(F.raise_error(F.concat(F.lit("not an agent: "), clean)))


def token_count(text: Column) -> Column:
    """About four characters are a token."""
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 4).cast("int")


def breadcrumb(*parts: Column) -> Column:
    """``a > b > c`` without empty parts; a list among them is joined too."""
    path = F.concat_ws(" > ", *[F.nullif(p, F.lit("")) for p in parts])
    return F.when(path == "", "Unknown Source").otherwise(path)


def seconds_of(stamp: Column, strict: bool = False) -> Column:
    """``HH:MM:SS.mmm`` or ``MM:SS.mmm`` in seconds; anything else is an error if strict, else 0."""
    parts = F.split(stamp, ":")
    n = F.size(parts)
    part = lambda i: F.get(parts, i)
    hours = F.when(n == 3, part(F.lit(0)).try_cast("int")).when(n == 2, F.lit(0))
    value = hours * 3600.0 + part(n - 2).try_cast("int") * 60.0 + part(n - 1).try_cast("double")
    if strict:
        return F.coalesce(value, F.raise_error(F.concat(F.lit("not a time: "), stamp)).cast("double"))
    return F.coalesce(value, F.lit(0.0))


def event_type(stage: Column, status: Column) -> Column:
    return F.concat_ws("_", stage, F.when(status == "started", "start").otherwise("complete"))


def sse_encode(event: Column) -> Column:
    return F.concat(F.lit("data: "), F.to_json(event), F.lit("\n\n"))


def sse_events(stream: Column) -> Column:
    """The JSON texts of all whole events of a stream; comments, other lines and what isn't whole at its end are left out."""
    frames = F.split(F.coalesce(stream, F.lit("")), "\n\n")
    whole = F.transform(F.slice(frames, 1, F.size(frames) - 1), lambda x: F.btrim(x, F.lit(" \t\r\n")))
    return F.transform(F.filter(whole, lambda x: x.startswith("data: ") & F.try_parse_json(F.substring(x, 7, 1 << 30)).isNotNull()), lambda x: F.substring(x, 7, 1 << 30))


def sse_decode(frame: Column, schema: str) -> Column:
    """The event of one frame; null for one that isn't whole."""
    return F.when(frame.startswith("data: ") & frame.endswith("\n\n"), F.from_json(F.substring(frame, 7, 1 << 30), schema))


def similarity_class(similarity: Column, threshold: float = 0.9) -> Column:
    """The class of a covered segment; below the threshold it is a gap."""
    return F.when(similarity >= 0.95, "high").when(similarity >= 0.90, "medium").when(similarity >= threshold, "low").otherwise("gap")


def coverage_class(percent: Column) -> Column:
    return F.when(percent >= 95, "high").when(percent >= 80, "medium").otherwise("low")


def storage_kb(dimension: Column, bytes_each: int) -> Column:
    return dimension * bytes_each / 1024.0


def expansion_queries(response: Column, original: Column) -> Column:
    """The four labelled lines of a response, in the order in which they come; the original fills up to four."""
    lines = F.transform(F.split(F.coalesce(response, F.lit("")), "\n"), lambda x: F.trim(x))
    labelled = F.filter(lines, lambda x: x.rlike("^(SPECIFIC|BROADER|KEYWORDS|CONTEXTUAL):"))
    texts = F.filter(F.transform(labelled, lambda x: F.trim(F.regexp_replace(x, "^[A-Z]+:", ""))), lambda x: x != "")
    return F.concat(texts, F.array_repeat(original, F.greatest(F.lit(4) - F.size(texts), F.lit(0))))


def multi_queries(response: Column, original: Column) -> Column:
    """The original and the first three lines that aren't blank."""
    lines = F.filter(F.transform(F.split(F.coalesce(response, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.concat(F.array(original), F.slice(lines, 1, 3))


#: The heading of retrieved chunks, the source of one without, and what stands before and for its text.
MARKDOWN = ("# Retrieved Information", "Unknown Source", "### Content:\n", "No content.")
PLAIN_MARKDOWN = ("# Retrieved Parenting Knowledge", "Unknown", "", "")


def documents_markdown(items: Column, words: tuple[str, str, str, str] = MARKDOWN) -> Column:
    """Retrieved chunks, an array of (source, text), as numbered sections; with PLAIN_MARKDOWN without a heading for the text."""
    title, unknown, heading, empty = words
    parts = F.transform(
        items, lambda d, i: F.concat(F.lit("## Source "), i + 1, F.lit(": "), F.coalesce(F.nullif(d["source"], F.lit("")), F.lit(unknown)), F.lit(f"\n\n{heading}"), F.coalesce(d["text"], F.lit(empty)), F.lit("\n\n---\n\n"))
    )
    none = F.lit("No relevant information found in the knowledge base.")
    return F.when(F.size(items) > 0, F.concat(F.lit(f"{title}\n\n"), F.array_join(parts, ""))).otherwise(none)
