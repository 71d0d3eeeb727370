"""Secret scans with corpus-wide ownership (operator 1).

Method: every candidate's value is hashed, and the hashes are counted over the whole
corpus by distinct repositories and owners. Three outcomes: a value of many owners, or of
more than one owner and many repositories, is a widely copied example; one of a single owner
that spreads over many repositories is undecided; any other belongs to few of both and is owner-specific.
Owner-specific values that look random and are no placeholder are live. Where a table names no
repository (``repo_col=None``), each distinct text is one: exact copies of a text spread nothing.
Candidates of the base kinds are always reported; the wider kinds (key blocks, other
providers' tokens, logins in addresses, runs of mixed random characters) unless they are copied or do not
look random. A random run inside another candidate is not one of its own.

Spans are kind:start:end in code points, end exclusive, ordered by start and then by
the order of the kinds. Values leave the scan as SHA-256 digests only.

Defined results: a null text counts as empty; a null owner is an owner of its own;
repeated rows get a row each; an empty table gives no rows; extra columns are not read
(``redact`` keeps them). Overlapping candidates of one kind never occur, of different
kinds they are all reported. A value that several kinds meet at one place occurs there once. Texts are
scanned whole, in time in proportion to their length; no kind has a greatest length.

Scale: texts are read once, where they are; candidates, which are few and small, are
written to the shared folder with the place of their document. A value that a third of
all documents carry is first folded to (value, repository, owner) in the task, and the
join that brings verdicts back is an equi-join that adaptive execution splits.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagfield.llm.common import fresh, located, settle

# Fixed values of the base rule: kind, pattern, group of the value, least length of it.
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
BASE = (
    (
        "assign",
        re.compile(
            r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
            re.IGNORECASE | re.ASCII,
        ),
        2,
        8,
    ),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]{32,}"), 0, 32),  # a longest run of 32 or more, as [0-9a-f]+ filtered by length
)
#: Wider kinds: a literal that must occur, the pattern, the group of the value.
WIDER = (
    ("provider", "gh", re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}"), 0),
    ("provider", "xox", re.compile(r"\bxox[abprs]-[A-Za-z0-9-]{20,}"), 0),
    ("provider", "AIza", re.compile(r"\bAIza[A-Za-z0-9_-]{35}"), 0),
    ("jwt", "eyJ", re.compile(r"\beyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+"), 0),
    ("login", "://", re.compile(r"://[A-Za-z0-9._-]++:([^\s:/@]{6,}+)@"), 1),
)
KINDS = ("assign", "access", "hex", "keyblock", "provider", "jwt", "login", "random")
KEY_BEGINS = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----")
KEY_ENDS = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----")
LEAST_KEY = 40
#: A run that may be random: its least length and entropy; it needs capitals, small letters and digits.
RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}+")
RUN_ENTROPY = 3.7
#: Values made of such words only, or that call themselves an example at their end, are placeholders.
PLACEHOLDER = re.compile(
    r"(?:example|sample|dummy|change|me|place|holder|your|my|test|secret|password|passwd|token|api|key|here|value|"
    r"x{3,}|0*1234567(?:89?0?)?|abcdefg?|[^A-Za-z0-9])+|\w{0,30}example(?:key)?",
    re.IGNORECASE | re.ASCII,
)
#: Owners, and repositories, from which a value counts as widely spread; least Shannon entropy of a live value, in bits a character.
COMMON_OWNERS = 3
COMMON_REPOS = 10
LEAST_ENTROPY = 2.5

CANDIDATE = "kind: string, start: long, end: long, at: long, value: string, random: boolean"


def entropy(value: str) -> float:
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def _key_blocks(text: str) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, start and end of what is inside) of each block from a BEGIN line to its END line."""
    begins = list(KEY_BEGINS.finditer(text)) if "PRIVATE KEY" in text else []
    end = None
    for m, after in zip(begins, [*(x.start() for x in begins[1:]), len(text)]):
        if end is None or end.start() < m.end():
            end = KEY_ENDS.search(text, m.end())
        if end is None:
            return
        if end.start() <= after and end.start() - m.end() >= LEAST_KEY:
            yield m.start(), end.end(), m.end(), end.start()


def _mixed(run: str) -> bool:
    return not (run.islower() or run.isupper()) and any(map(str.isdigit, run)) and entropy(run) >= RUN_ENTROPY


def candidates(text: str) -> list[tuple[str, int, int, int, str, bool]]:
    """(kind, start, end, start of the value, SHA-256 of the value, looks random) of every candidate, ordered."""
    found = []

    def add(kind: str, start: int, end: int, at: int, value: str) -> None:
        digest = hashlib.sha256(value.encode(errors="surrogatepass")).hexdigest()
        random = entropy(value) >= LEAST_ENTROPY and not PLACEHOLDER.fullmatch(value)
        found.append((kind, start, end, at, digest, random))

    def add_match(kind: str, match: re.Match, group: int) -> None:
        add(kind, match.start(), match.end(), match.start(group), match[group])

    lower = text.lower()
    if any(k in lower for k in KEYWORDS):
        for m in BASE[0][1].finditer(text):
            if len(m[2]) >= BASE[0][3]:
                add_match("assign", m, 2)
    if "AKIA" in text:
        for m in BASE[1][1].finditer(text):
            if len(m[0]) >= BASE[1][3]:
                add_match("access", m, 0)
    for m in BASE[2][1].finditer(text):
        add_match("hex", m, 0)
    for start, end, at, to in _key_blocks(text):
        add("keyblock", start, end, at, text[at:to])
    for kind, literal, pattern, group in WIDER:
        if literal in text:
            for m in pattern.finditer(text):
                add_match(kind, m, group)
    runs = [m for m in RUN.finditer(text) if _mixed(m[0])]
    if runs:
        # Each run against the candidate that begins last before its end, and the furthest end until there.
        spans = sorted((c[1], c[2]) for c in found)
        begins, furthest = [b for b, _ in spans], list(itertools.accumulate((e for _, e in spans), max))
        for m in runs:
            before = bisect.bisect_left(begins, m.end())
            if not before or furthest[before - 1] <= m.start():
                add_match("random", m, 0)
    return sorted(found, key=lambda c: (c[1], KINDS.index(c[0]), c[2]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("at", pa.int64()), ("value", pa.string()), ("random", pa.bool_())]
    names = [n for n, _ in fields]
    for batch in batches:
        found = [[dict(zip(names, c)) for c in candidates(t or "")] for t in batch.column(0).to_pylist()]
        column = pa.array(found, pa.list_(pa.struct(fields)))
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], column], [*batch.schema.names[1:], "found"])


def scan(
    docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str | None, file: str, row: str
) -> DataFrame:
    """(id, owner, repo, file, row, found) of every row of a placed table; written once."""
    wanted = docs.select(
        F.col(text_col).alias("text"),
        F.col(id_col).alias("id"),
        F.col(owner_col).cast("string").alias("owner"),
        (F.col(repo_col) if repo_col else F.xxhash64(text_col)).cast("string").alias("repo"),
        F.col(file).alias("file"),
        F.col(row).alias("row"),
    )
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, owner string, repo string, file string, row long, found array<struct<{CANDIDATE}>>"
    return settle(wanted.mapInArrow(_scan, schema), "candidates")


def ownership(
    found: DataFrame, common_owners: int = COMMON_OWNERS, common_repos: int = COMMON_REPOS
) -> DataFrame:
    """(value, owners, repos, occurrences, copied, undecided) of every candidate value of the corpus."""
    places = F.array_distinct(F.transform("found", lambda c: F.struct(c["at"].alias("at"), c["value"].alias("value"))))
    each = found.select("owner", "repo", F.explode(places.getField("value")).alias("value"))
    folded = each.groupBy("value", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = folded.groupBy("value", "owner").agg(F.sum("n").alias("n"))
    owned = by_owner.groupBy("value").agg(F.count("*").alias("owners"), F.sum("n").alias("occurrences"))
    spread = folded.select("value", "repo").distinct().groupBy("value").agg(F.count("*").alias("repos"))
    many = F.col("repos") >= common_repos
    copied = (F.col("owners") >= common_owners) | (many & (F.col("owners") > 1))
    return owned.join(spread, "value").select(
        "value", "owners", "repos", "occurrences", copied.alias("copied"), (many & ~copied).alias("undecided")
    )


def judged(found: DataFrame, common_owners: int = COMMON_OWNERS, common_repos: int = COMMON_REPOS) -> DataFrame:
    """Candidates with their verdict: (file, row, kind, start, end, value, owners, repos, copied, undecided, live, reported).

    ``live`` values are owner-specific and look random; ``undecided`` ones look random too. Both
    are ``reported``, as are all of the base kinds.
    """
    each = found.select("file", "row", F.explode("found").alias("c")).select("file", "row", "c.*")
    return (
        each.join(ownership(found, common_owners, common_repos), "value")
        .withColumn("live", F.col("random") & ~F.col("copied") & ~F.col("undecided"))
        .withColumn("undecided", F.col("random") & F.col("undecided"))
        .withColumn("reported", F.col("kind").isin(*[b[0] for b in BASE]) | F.col("live") | F.col("undecided"))
    )


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def find_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repo_col: str | None = None,
    common_owners: int = COMMON_OWNERS,
    common_repos: int = COMMON_REPOS,
) -> DataFrame:
    """One row a document: doc_id, counts of the base kinds, base_sha256, spans, n_live, n_undecided, n_copied, span_owners, span_repos.

    The last two are the owners and the repositories of each reported span's value, in the order of ``spans``.
    """
    file, row = fresh(docs, "at_file"), fresh(docs, "at_row")
    found = scan(located(docs, file, row), id_col, text_col, owner_col, repo_col, file, row)
    base = [b[0] for b in BASE]
    order = F.struct("start", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("o"), "end", "kind", "owners", "repos")
    verdicts = (
        judged(found, common_owners, common_repos)
        .groupBy("file", "row")
        .agg(
            F.sort_array(F.collect_list(F.when(F.col("reported"), order))).alias("reported"),
            F.count_if("live").alias("n_live"),
            F.count_if("undecided").alias("n_undecided"),
            F.count_if("copied").alias("n_copied"),
        )
    )
    none = F.lit(0).cast("long")
    own = F.filter("found", lambda c: c["kind"].isin(*base))

    def count_of(kind: str) -> Column:
        return F.size(F.filter("found", lambda c: c["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.join(verdicts, ["file", "row"], "left").select(
        F.col("id").alias("doc_id"),
        *map(count_of, base),
        F.sha2(_joined(own), 256).alias("base_sha256"),
        F.coalesce(_joined(F.col("reported")), F.lit("")).alias("spans"),
        F.coalesce("n_live", none).alias("n_live"),
        F.coalesce("n_undecided", none).alias("n_undecided"),
        F.coalesce("n_copied", none).alias("n_copied"),
        *(
            F.coalesce(F.array_join(F.col(f"reported.{c}").cast("array<string>"), ","), F.lit("")).alias(f"span_{c}")
            for c in ("owners", "repos")
        ),
    )


def redact(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repo_col: str | None = None,
    chars_col: str | None = "n_chars",
    common_owners: int = COMMON_OWNERS,
    common_repos: int = COMMON_REPOS,
    mark: str = "[secret]",
) -> DataFrame:
    """``docs`` with every live or undecided value's span replaced by ``mark``; widely copied examples stay.

    ``chars_col`` (None: no such column) is set to the new length where a text changed.
    """
    file, row, cuts = fresh(docs, "at_file"), fresh(docs, "at_row"), fresh(docs, "at_cuts")
    placed = located(docs, file, row)
    found = scan(placed, id_col, text_col, owner_col, repo_col, file, row)
    live = (
        judged(found, common_owners, common_repos)
        .where("live OR undecided")
        .groupBy(F.col("file").alias("f"), F.col("row").alias("r"))
        .agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(cuts))
    )

    @F.pandas_udf("string")
    def blot(texts, spans):
        def one(text, own):
            if own is None:
                return text
            out, done = [], 0
            for s in own:
                if s["end"] <= done:
                    continue
                out += [text[done : s["start"]], mark if s["start"] >= done else ""]
                done = s["end"]
            return "".join(out) + text[done:]

        return texts.combine(spans, one)

    joined = placed.join(live, (placed[file] == live.f) & (placed[row] == live.r), "left")
    changed = joined.withColumn(text_col, blot(F.col(text_col), F.col(cuts)))
    if chars_col:
        length = F.length(text_col).cast(docs.schema[chars_col].dataType)
        changed = changed.withColumn(chars_col, F.when(F.col(cuts).isNull(), F.col(chars_col)).otherwise(length))
    return changed.select(*docs.columns)
