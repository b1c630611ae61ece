"""Secret scan by multipart credential linking (DataFrame functions only).

Strong candidates stand alone: assignments to a secret's name, access keys and
long hexadecimal strings (kinds assign, access, hex).  Weak ones are parts that
mean little by themselves: an identifier (user, login, client id, access key id), a secret
value without a telling name (pass, pwd, key, auth), a bare 40-character key
body (kind body) and an endpoint (URL with a host, host or server setting).
Names of the weak kinds may have a prefix (db_user, aws_secret_access_key,
secretAccessKey).  A weak candidate is reported only where complementary parts
co-occur in its scope: an identifier or an endpoint beside a secret, strong or
weak, and a weak secret or a key body beside an access key, an identifier or an
endpoint.

Scope: ``reach`` characters around the candidate.  The interval join puts every
part into the buckets of ``reach`` characters that its interval touches, and
joins candidates to partners on (row, bucket) and overlap.  It only asks whether
a partner exists.  Matches of a kind do not overlap and have 6 characters at
least, so a bucket holds at most ``reach`` / 6 + 2 of each, whatever the text's
length.

Places of matches come from the texts between them: splitting a text at a
pattern gives the gaps, extracting gives the matches, and the running sum of
their lengths gives every span in code points.  A text is searched for a kind
only if it holds one of the words without which the kind's pattern cannot match.

Edge cases: a null text counts as empty; rows that repeat a doc_id are
scanned each; spans of different kinds may overlap; a null doc_id stays null;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reclaim.llm.common import stage, text_of

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
#: kind -> pattern, group whose length counts, least length
BASE = {
    "assign": (ASSIGN, 2, 6),
    # a run of 20 or more from the first AKIA of a run is what AKIA[A-Z0-9]+ finds and keeps
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    # likewise: a match of [0-9a-f]+ is a whole run
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}

def _named(names: str, humps: str) -> str:
    """``names`` in any case as the last word of a name, after _ or as a hump."""
    return rf"""\b(?:(?:[A-Za-z0-9_]*?_)?(?i:{names})|[A-Za-z0-9_]*?[a-z0-9](?:{humps}))"""


WEAK = {
    "id": (_named("user(?:_?name)?|login|client_?id|account_?id|access_?key_?id", "User(?:_?[Nn]ame)?|Login|(?:Client|Account|Access_?Key)_?I[Dd]") + r"""(?i:["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@+-]{3,})""", 0, 6),
    "value": (_named("pass|pwd|key|auth|credential", "Pass|Pwd|Key|Auth|Credential") + r"""(?i:["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,})""", 0, 6),
    "endpoint": (r"""(?:(?i:\b[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9._~%:@-]{3,})|""" + _named("host|server|endpoint", "Host|Server|Endpoint")
                 + r"""(?i:["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{3,}))""", 0, 6),
}
#: Also weak: a run of just 40, neither an access key itself nor hexadecimal, which is strong.
BODY = {"body": (r"(?<![A-Za-z0-9/+])(?!AKIA[A-Z0-9]{16}|[0-9a-f]{40})[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=])", 0, 40)}
#: Words, in lower case, of which a text with a match holds one.
WORDS = {"assign": ["passw", "secret", "token", "api"], "access": ["akia"], "id": ["user", "login", "id"],
         "value": ["pass", "pwd", "key", "auth", "credential"], "endpoint": ["://", "host", "server", "endpoint"]}
ALL_KINDS = [*BASE, *WEAK, *BODY]
#: What a weak candidate needs beside it, and what each kind can be beside another.
NEEDS = {"id": "secret", "endpoint": "secret", "value": "party", "body": "party"}
ROLES = {"assign": ["secret"], "access": ["secret", "party"], "hex": ["secret"], "value": ["secret"], "body": ["secret"],
         "id": ["party"], "endpoint": ["party"]}
REACH = 200


def _matches(text: Column, kind: str) -> Column:
    """Matches of one kind in order: its number, their place in the list, the
    length of the gap before, of the match and of the part that counts."""
    pattern, group, least = {**BASE, **WEAK, **BODY}[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.arrays_zip(F.transform(F.split(text, pattern), F.length).alias("gap"), found.alias("m"))
    value = (lambda m: F.regexp_extract(m, pattern, group)) if group else (lambda m: m)
    listed = F.transform(F.filter(parts, lambda p: p["m"].isNotNull()), lambda p, i: F.struct(
        F.lit(ALL_KINDS.index(kind)).alias("kind"), i.alias("nth"), p["gap"].alias("gap"), F.length(p["m"]).alias("size"),
        (F.length(value(p["m"])) >= least).alias("long")))
    # most texts hold none: a look for its words, then one for the pattern tells
    words = reduce(lambda a, b: a | b, [F.lower(text).contains(w) for w in WORDS[kind]]) if kind in WORDS else F.lit(True)
    return F.when(words & F.regexp_like(text, F.lit(pattern)), listed).otherwise(
        F.array().cast("array<struct<kind:int,nth:int,gap:int,size:int,long:boolean>>"))


def _of_kind(kind: Column, values: dict) -> Column:
    """The entry of ``values`` for a kind given by its number."""
    cases = [F.when(kind == ALL_KINDS.index(k), F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v))
             for k, v in values.items()]
    return F.coalesce(*cases)


def linked(spans: DataFrame, reach: int = REACH) -> DataFrame:
    """Weak candidates of ``spans`` (row, kind, start, end) with a partner
    within ``reach`` characters."""
    weak = spans.filter(F.col("kind") >= len(BASE)).withColumn("role", _of_kind(F.col("kind"), NEEDS))
    weak = weak.withColumn("bucket", F.explode(F.sequence(
        F.floor((F.col("start") - reach) / reach), F.floor((F.col("end") + reach) / reach))))
    part = spans.select(F.col("row").alias("p_row"), F.explode(_of_kind(F.col("kind"), ROLES)).alias("p_role"),
                        F.col("start").alias("p_start"), F.col("end").alias("p_end"))
    part = part.withColumn("p_bucket", F.explode(F.sequence(F.floor(F.col("p_start") / reach), F.floor(F.col("p_end") / reach))))
    near = (F.col("p_start") < F.col("end") + reach) & (F.col("p_end") > F.col("start") - reach)
    same = (F.col("row") == F.col("p_row")) & (F.col("bucket") == F.col("p_bucket")) & (F.col("role") == F.col("p_role"))
    return weak.join(part, same & near, "left_semi").select("row", "kind", "start", "end").distinct()


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """One row for each row of ``docs``: doc_id and spans, an array of (start,
    kind, end) in order of start, then of kind as listed in ALL_KINDS."""
    text = text_of(text_col)
    rows = stage(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.concat(*[_matches(text, k) for k in ALL_KINDS]).alias("found"))
                 .withColumn("row", F.monotonically_increasing_id()), "matches")
    each = rows.select("row", F.explode("found").alias("f")).select("row", "f.*")
    upto = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("row", "kind").orderBy("nth"))
    spans = stage(each.withColumn("end", upto).filter("long").select(
        "row", "kind", (F.col("end") - F.col("size")).alias("start"), "end"), "spans")
    every = spans.filter(F.col("kind") < len(BASE)).unionByName(linked(spans, reach))
    by_row = every.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    return rows.select("row", "doc_id").join(by_row, "row", "left").select("doc_id", F.coalesce(
        "spans", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")).alias("spans"))


def digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in ALL_KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(found: DataFrame) -> DataFrame:
    """``scan``'s rows with the counts and digests of the spans."""
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == ALL_KINDS.index(k))).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE],
                        F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))
