"""Secret scans through an incremental blob ledger (operator 9). DataFrame functions only.

Every version of a text is a blob, named by its SHA-256. The ledger has one row per blob and
version of the rules that was scanned, with the spans found (none is a row as well). A scan
keeps one text per new blob, leaves out what the ledger has, looks at the rest, and joins the
spans back to all paths that hold a blob.

Places come from the two halves of a regular expression's work: ``split`` gives the texts
between matches and ``regexp_extract_all`` the matches, so the running sum of their lengths
(in code points) is where each match begins.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolytics.llm.common import keep, text_column


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    #: Texts without this string have no match; '' if no such string is known.
    needs: str = ""


#: The base kinds, in order.
BASE = (
    Rule(
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
        r"""([A-Za-z0-9+/_.=-]+)""",
        6,
        2,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 20, needs="AKIA"),
    Rule("hex", r"[0-9a-f]{24,}", 24),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", needs="PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", needs="gh"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", needs="xox"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", needs="AIza"),
    # A match begins where a run of its characters does, so that a long run is looked at once.
    Rule(
        "jwt",
        r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+",
        needs="eyJ",
    ),
    Rule(
        "login_url",
        r"(?<![a-z0-9+.-])[a-z][a-z0-9+.-]*+://[^\s/:@]++:[^\s/:@]++@",
        needs="://",
    ),
)
RULES = BASE + MORE
RULE_VERSION = "2"
SPAN = "struct<start:int,rank:int,kind:string,end:int>"
LEDGER = f"blob string, rule_version string, spans array<{SPAN}>"
#: Sums run over blocks of so many lengths, so that n matches cost n * BLOCK steps at most.
BLOCK = 128


def let(value: Column, body) -> Column:
    """body(value), with ``value`` computed once however often the body or its lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, x: a + x)


def _lengths(texts: Column) -> Column:
    return F.transform(texts, lambda x: F.char_length(x))


def _block_sums(steps: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.floor(F.size(steps) / BLOCK).cast("int")),
        lambda b: _total(F.slice(steps, b * BLOCK + 1, F.lit(BLOCK))),
    )


def rule_spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans (start, rank, kind, end) of a rule's matches in ``text``, left to right."""
    pattern = F.lit(rule.pattern)
    matched = F.regexp_extract_all(text, pattern, F.lit(0))
    group = matched if not rule.group else F.regexp_extract_all(text, pattern, F.lit(rule.group))

    def place(m, steps, blocks, i):
        b = F.floor(i / BLOCK).cast("int")
        before = _total(F.slice(blocks, F.lit(1), b)) + _total(
            F.slice(steps, b * BLOCK + 1, i - b * BLOCK)
        )
        return let(
            before + F.get(m["between"], i),
            lambda start: F.struct(
                start.alias("start"),
                F.lit(rank).alias("rank"),
                F.lit(rule.kind).alias("kind"),
                (start + F.get(m["lengths"], i)).alias("end"),
            ),
        )

    def places(m):
        fine = F.filter(
            F.sequence(F.lit(0), F.size(m["lengths"]) - 1),
            lambda i: F.get(m["measured"], i) >= rule.least,
        )
        steps = F.zip_with(m["lengths"], m["between"], lambda x, y: F.coalesce(x, F.lit(0)) + y)
        return let(
            steps,
            lambda st: let(
                _block_sums(st),
                lambda bl: F.transform(fine, lambda i: place(m, st, bl, i)),
            ),
        )

    measured = F.struct(
        _lengths(matched).alias("lengths"),
        _lengths(group).alias("measured"),
        _lengths(F.split(text, rule.pattern, -1)).alias("between"),
    )
    possible = F.regexp_like(text, pattern)
    if rule.needs:
        possible = text.contains(rule.needs) & possible
    return F.when(possible, let(measured, places)).otherwise(F.array()).cast(f"array<{SPAN}>")


def text_spans(text: Column, rules: Sequence[Rule] = RULES) -> Column:
    """All rules' spans by start, then by the order of the rules."""
    return F.array_sort(F.concat(*[rule_spans(text, r, i) for i, r in enumerate(rules)]))


def joined(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ","
    )


def blobs_of(versions: DataFrame, *paths: str) -> DataFrame:
    """The path columns of each version, and the blob that its text is."""
    return versions.select(
        *[versions[p] for p in paths], F.sha2(text_column(versions, "text"), 256).alias("blob")
    )


def scanned(
    versions: DataFrame,
    ledger: DataFrame | None = None,
    rules: Sequence[Rule] = RULES,
    rule_version: str = RULE_VERSION,
) -> DataFrame:
    """New rows of the ledger: blobs of ``versions`` that it lacks for this rule version.

    Copies meet in a partial aggregation before the shuffle, so a blob with very many paths
    travels once per task.
    """
    text = text_column(versions, "text")
    blobs = (
        versions.select(F.sha2(text, 256).alias("blob"), text.alias("text"))
        .groupBy("blob")
        .agg(F.any_value("text").alias("text"))
    )
    if ledger is not None:
        known = ledger.where(F.col("rule_version") == rule_version).select("blob")
        blobs = blobs.join(known, "blob", "left_anti")
    return blobs.select(
        "blob",
        F.lit(rule_version).alias("rule_version"),
        text_spans(F.col("text"), rules).alias("spans"),
    )


def scan(
    versions: DataFrame,
    ledger: DataFrame | None = None,
    rules: Sequence[Rule] = RULES,
    rule_version: str = RULE_VERSION,
    paths: Sequence[str] = ("doc_id",),
) -> tuple[DataFrame, DataFrame]:
    """(findings, ledger): spans of every version, and the ledger with the new blobs.

    ``versions``: path columns and text, any number of versions per path. findings: path
    columns, blob, spans (array of start, rank, kind, end; code points, end exclusive),
    one row per version. A null text is the empty one. Repeated rows and null paths get a row
    each; an empty table gives an empty result; other columns are not read. The new rows are
    written once, so the returned ledger can be stored or used again without a new scan.
    """
    new = keep(scanned(versions, ledger, rules, rule_version), "secret-ledger")
    whole = new if ledger is None else ledger.select(*new.columns).unionByName(new)
    current = whole.where(F.col("rule_version") == rule_version).select("blob", "spans")
    findings = blobs_of(versions, *paths).join(current, "blob", "left")
    return findings.select(*paths, "blob", "spans"), whole


def digests(documents: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, blob) per row of ``documents``."""
    versions = documents.select(
        documents["doc_id"].cast("long").alias("doc_id"), documents["text"].alias("text")
    )
    findings, _ = scan(versions, ledger)
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("spans", lambda x: x["rank"] < len(BASE))
    return findings.select(
        "doc_id",
        *[count(r.kind).alias(f"n_{r.kind}") for r in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        "blob",
    )


def _merged(spans: Column) -> Column:
    """Sorted spans with overlapping and touching ones made one (start, end)."""

    def step(acc, x):
        rest, last = F.slice(acc, F.lit(1), F.size(acc) - 1), F.get(acc, F.size(acc) - 1)
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        new = F.struct(x["start"].alias("start"), x["end"].alias("end"))
        touches = (F.size(acc) > 0) & (x["start"] <= last["end"])
        return F.when(touches, F.concat(rest, F.array(grown))).otherwise(F.concat(acc, F.array(new)))

    return F.aggregate(spans, F.array().cast("array<struct<start:int,end:int>>"), step)


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """``text`` with each stretch that spans cover replaced by ``mark``."""

    def between(parts):
        begin = lambda i: F.coalesce(F.get(parts, i - 1)["end"], F.lit(0))
        end = lambda i: F.coalesce(F.get(parts, i)["start"], F.char_length(text))
        return F.transform(
            F.sequence(F.lit(0), F.size(parts)),
            lambda i: text.substr(begin(i) + 1, end(i) - begin(i)),
        )

    return F.array_join(let(_merged(spans), between), mark)


def without_secrets(documents: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``documents`` with the secrets of each text replaced by ``mark`` and n_chars renewed.

    Texts without secrets, null texts and all other columns stay as they are.
    """
    columns = documents.columns
    new = keep(scanned(documents.select(documents["text"])), "secret-ledger")
    found = new.where(F.size("spans") > 0).select(
        F.col("blob").alias("_blob"), F.col("spans").alias("_spans")
    )
    rows = documents.select(
        F.struct(*[documents[c] for c in columns]).alias("_row"),
        F.sha2(text_column(documents, "text"), 256).alias("_blob"),
    ).join(_small(found), "_blob", "left")
    text, spans = F.col("_row")["text"], F.col("_spans")
    clean = F.when(spans.isNotNull(), redacted(text, spans, mark)).otherwise(text)
    rows = rows.select("_row", "_spans", clean.alias("_text"))
    names = {"text": F.col("_text")}
    if "n_chars" in columns:
        kind = documents.schema["n_chars"].dataType
        names["n_chars"] = F.when(
            F.col("_spans").isNotNull(), F.char_length("_text").cast(kind)
        ).otherwise(F.col("_row")["n_chars"])
    return rows.select(*[names.get(c, F.col("_row")[c]).alias(c) for c in columns])


def _small(found: DataFrame) -> DataFrame:
    """``found`` with a broadcast hint if its rows and spans are few (about 10 MB at most)."""
    rows, spans = found.agg(F.count(F.lit(1)), F.sum(F.size("_spans"))).first()
    return F.broadcast(found) if rows <= 50_000 and (spans or 0) <= 200_000 else found
