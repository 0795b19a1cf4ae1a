"""Personal data by bootstrapped contextual extraction.

Base matches of four kinds are seeds, and so are key-like strings, the seeds of a fifth kind, secret. Their neighbouring words induce lexical patterns; all other identifier-like strings are candidates. Over the graph of patterns and
instances Spark scores both in turn: a pattern by the share of believed instances among its distinct ones, an instance by its patterns (noisy-or), as in mutual bootstrapping (Riloff
and Jones, 1999). Candidates that confident patterns agree on are added as spans of the patterns' kind. A key-like string is no base match: its form alone, which a checksum has too, is not enough,
and it is added where a confident pattern of secrets holds it.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import cut, drop_cut

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
SECRET = len(KINDS)
#: Rounds of scoring; distinct believed instances that a pattern needs; the least score of a pattern that counts; the least confidence of an added instance.
ROUNDS, SUPPORT, PATTERN_SCORE, CONFIDENCE = 3, 4, 0.6, 0.9
#: Weight against a pattern of an instance that is not known but has the kind's form; all other instances that are not of the kind have weight 1.
UNKNOWN = 0.2
#: Neighbouring words longer than this stand in patterns by a digest of the whole word.
SPELLED = 64

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: Identifier-like: digit groups joined by single spaces or hyphens, or a word with a digit or an at sign.
_CANDIDATE = re.compile(r"(?<!\S)(?:\(?\+?[0-9][0-9().\-]*(?: \(?[0-9][0-9().\-]*)+(?!\S)|\S*[0-9@]\S*)")
_KEY = re.compile(r"[0-9A-Za-z_/+=-]+")
_CHANGE = re.compile(r"(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]")
_EDGES = "\"'.,;:!?()<>[]{}$%&*#|=~`"


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def _emails(text: str):
    """Leftmost matches: from the start of the run of local characters before an at sign; each at sign is tried once."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text, start - 1):
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            end = found.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base matches in code points, by kind and start."""
    out = [(0, s, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text) is None:
        return out
    if "." in text:
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(d := p.lstrip("0")) <= 3 and int(d or "0") <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := m.group().replace(" ", "").replace("-", "")) <= 19 and _luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def _shapes(s: str) -> int:
    """A bit for each kind that a candidate's form allows."""
    digits = sum("0" <= c <= "9" for c in s)
    groups = re.split(r"[.:]", s)
    return (
        ("@" in s and 5 <= len(s))
        | (len(groups) >= 4 and all(re.fullmatch(r"[0-9A-Fa-f]{0,4}", g) for g in groups) and digits >= 3) << 1
        | (12 <= digits <= 19 and bool(re.fullmatch(r"[0-9 -]+", s))) << 2
        | (7 <= digits <= 15 and bool(re.fullmatch(r"[0-9 ().+/-]+", s))) << 3
        | (12 <= len(s) and digits < len(s) and _KEY.fullmatch(s) is not None) << SECRET
    )


def _key_like(s: str) -> bool:
    """At least 24 letters and digits that change about as often as at random."""
    return len(s) >= 24 and _KEY.fullmatch(s) is not None and 6 * len(_CHANGE.findall(s)) >= len(s)


def _spelled(word: str) -> str:
    return word.lower() if len(word) <= SPELLED else "#" + hashlib.sha256(word.lower().encode("utf-8", "surrogatepass")).hexdigest()[:32]


def _neighbours(text: str, spans: list[tuple[int, int]]) -> list[tuple[list[str], list[str]]]:
    """Of each span, up to two words before and two after it. Another span next to it counts as one word, `<>`, and words behind that are not read:
    so the stretches between spans are each read a bounded number of times, however long their words are."""
    starts, ends = sorted(s for s, _ in spans), sorted(e for _, e in spans)
    out = []
    for s, e in spans:
        i, j = bisect_right(ends, s) - 1, bisect_left(starts, e)
        before, after = text[ends[i] if i >= 0 else 0 : s], text[e : starts[j] if j < len(starts) else len(text)]
        left, right = [_spelled(w) for w in before.rsplit(None, 2)[-2:]], [_spelled(w) for w in after.split(None, 2)[:2]]
        out.append(((["<>"] * (i >= 0) + left)[-2:], (right + ["<>"] * (j < len(starts)))[:2]))
    return out


def _patterns(left: list[str], right: list[str]) -> list[str]:
    """Patterns of neighbouring words: one and two to the left, one to each side, two to the right."""
    out = []
    if left:
        out.append(f"l:{left[-1]}")
        if right:
            out.append(f"b:{left[-1]} _ {right[0]}")
    if len(left) == 2:
        out.append(f"l:{left[0]} {left[1]}")
    if len(right) == 2:
        out.append(f"r:{right[0]} {right[1]}")
    return out


def scan(text: str) -> tuple[list[tuple], list[tuple]]:
    """Base spans; and (start, end, instance, seed kind or -1, shapes, patterns) of the base spans and all candidates."""
    spans = base_spans(text)
    if not spans and _DIGIT.search(text) is None and "@" not in text:
        return spans, []
    items = [(s, e, text[s:e].lower(), k, 1 << k) for k, s, e in spans]
    covered = sorted((s, e) for _, s, e in spans)
    i = 0
    for m in _CANDIDATE.finditer(text):
        s, e = m.span()
        while s < e and text[s] in _EDGES:
            s += 1
        while s < e and text[e - 1] in _EDGES:
            e -= 1
        while i < len(covered) and covered[i][1] <= s:
            i += 1
        if e - s < 5 or any(a < e for a, _ in covered[i : i + 1]):
            continue
        shapes = _shapes(text[s:e])
        if shapes:
            items.append((s, e, text[s:e].lower(), SECRET if shapes >> SECRET & 1 and _key_like(text[s:e]) else -1, shapes))
    around = _neighbours(text, [x[:2] for x in items])
    return spans, [(*x, _patterns(*n)) for x, n in zip(items, around)]


_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
_ITEM = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("instance", pa.string()), ("seed", pa.int32()), ("shapes", pa.int32()), ("patterns", pa.list_(pa.string()))])
_SCHEMA = "base array<struct<kind:int,start:long,end:long>>, items array<struct<start:long,end:long,instance:string,seed:int,shapes:int,patterns:array<string>>>"


def _scanned(docs: DataFrame, text_col: str) -> DataFrame:
    """carried (a struct), its row number rid, base spans and items; written once."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                found = [scan(t or "") for t in part.column(1).to_pylist()]
                base = pa.array([[dict(zip(("kind", "start", "end"), s)) for s in f[0]] for f in found], pa.list_(_SPAN))
                items = pa.array([[dict(zip(("start", "end", "instance", "seed", "shapes", "patterns"), x)) for x in f[1]] for f in found], pa.list_(_ITEM))
                yield pa.RecordBatch.from_arrays([part.column(0), base, items], ["carried", "base", "items"])

    carried = docs.schema["carried"].dataType.simpleString()
    return cut(docs.mapInArrow(run, f"carried {carried}, {_SCHEMA}").withColumn("rid", F.monotonically_increasing_id()))


def believed_instances(scanned: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(iid, kind) of the candidates that confident patterns agree on, and of key-like strings that a confident pattern of secrets holds. Rows of the graph are distinct pairs, so that copies of a text count once."""
    item = scanned.select(F.explode("items").alias("i")).select("i.*")
    edges = cut(item.select(F.xxhash64("instance").alias("iid"), "seed", "shapes", F.explode("patterns").alias("p")).groupBy("iid", F.xxhash64("p").alias("pid")).agg(F.max("seed").alias("seed"), F.max("shapes").alias("shapes")))
    known = [F.count_if(F.expr(f"seed = {k}")).alias(f"known{k}") for k in range(len(ALL_KINDS))]
    maybe = [F.count_if(F.expr(f"seed < 0 and (shapes >> {k}) & 1 = 1")).alias(f"maybe{k}") for k in range(len(ALL_KINDS))]
    against = F.array(*(F.col("all") - F.col(f"known{k}") - (1 - UNKNOWN) * F.col(f"maybe{k}") for k in range(len(ALL_KINDS)))).alias("against")
    counts = cut(edges.groupBy("pid").agg(F.count("*").alias("all"), *known, *maybe).filter(" + ".join(f"known{k}" for k in range(len(ALL_KINDS))) + " > 0").select("pid", against))
    seeds = cut(edges.filter("seed >= 0").groupBy("iid").agg(F.max("seed").alias("kind"), F.lit(1.0).alias("belief")))
    belief, new, scored = seeds, None, None
    open_edges = cut(edges.join(counts.select("pid"), "pid", "left_semi").join(seeds.select("iid"), "iid", "left_anti").select("iid", "pid", "shapes"))
    for _ in range(rounds):
        if scored is not None:
            drop_cut(scored)
        sums = edges.select("iid", "pid").join(belief, "iid").groupBy("pid", "kind").agg(F.sum("belief").alias("sum"), F.count_if(F.expr("belief >= 0.5")).alias("support"))
        scored = cut(sums.filter(F.col("support") >= SUPPORT).join(counts, "pid").select("pid", "kind", (F.col("sum") / (F.col("sum") + F.get("against", "kind") + 0.25)).alias("score")).filter(F.col("score") >= PATTERN_SCORE))
        doubt = F.sum(F.log(F.lit(1.0) - F.least("score", F.lit(0.999))))
        fits = F.expr("(shapes >> kind) & 1 = 1")
        found = open_edges.join(scored, "pid").filter(fits).groupBy("iid", "kind").agg((1 - F.exp(doubt)).alias("belief"))
        best = found.groupBy("iid").agg(F.max(F.struct("belief", (-F.col("kind")).alias("k"))).alias("x")).select("iid", (-F.col("x.k")).alias("kind"), "x.belief")
        if new is not None:
            drop_cut(new)
        new = cut(best)
        belief = seeds.union(new)
    held = edges.filter(F.col("seed") == SECRET).join(scored.filter(F.col("kind") == SECRET), "pid", "left_semi").select("iid", F.col("seed").alias("kind")).distinct()
    return new.filter(F.col("belief") >= CONFIDENCE).select("iid", "kind").union(held)


def _with_spans(scanned: DataFrame) -> DataFrame:
    """carried, base and spans: base and added ones, sorted."""
    believed = cut(believed_instances(scanned))
    if believed.isEmpty():
        return scanned.select("carried", "base", F.col("base").alias("spans"))
    item = scanned.select("rid", F.explode("items").alias("i")).filter(f"i.seed < 0 or i.seed = {SECRET}").select("rid", "i.start", "i.end", F.xxhash64("i.instance").alias("iid"))
    added = cut(item.join(believed, "iid").groupBy("rid").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added")))
    return scanned.join(added, "rid", "left").select("carried", "base", F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(scanned.schema["base"].dataType)))).alias("spans"))


def _text(spans: str):
    kind = F.array(*map(F.lit, ALL_KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone (base matches), base_sha256 of the base spans, spans (base and added), n_added, n_spans.

    Spans are kind:start:end in code points, end exclusive, by kind in the order of ALL_KINDS, then start, joined by commas. Null text counts as empty. Added spans never overlap base
    ones. Repeated rows each give a row and count once as evidence. Texts are read whole.
    """
    rows = docs.select(F.struct(F.col(id_col).cast("long").alias("doc_id")).alias("carried"), F.col(text_col).alias("text"))
    found = _with_spans(_scanned(rows, "text"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("carried.doc_id", *counts, F.sha2(_text("base"), 256).alias("base_sha256"), _text("spans").alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"), F.size("spans").cast("long").alias("n_spans"))


def redact_text(text: str, spans) -> str:
    """text with each span replaced by its kind in brackets; of overlapping spans the union, named after the first."""
    out, at = [], 0
    merged: list[list] = []
    for kind, start, end in sorted(spans, key=lambda s: (s[1], s[0])):
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(end, merged[-1][2])
        else:
            merged.append([kind, start, end])
    for kind, start, end in merged:
        out += [text[at:start], f"[{ALL_KINDS[kind].upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with all spans of personal_data replaced in the text, and length_col, where there is one, set to the new length; other columns as they came."""
    carried = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("carried")
    found = _with_spans(_scanned(docs.select(carried, F.col(text_col).alias("text")), "text"))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                pairs = zip(part.column(0).field(text_col).to_pylist(), part.column(1).to_pylist())
                new = pa.array((redact_text(t, [(x["kind"], x["start"], x["end"]) for x in s]) if s else t for t, s in pairs), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), new], ["carried", "clean"])

    kind = found.schema["carried"].dataType.simpleString()
    clean = found.select("carried", "spans").mapInArrow(run, f"carried {kind}, clean string")
    new = {text_col: F.col("clean"), length_col: F.length("clean").cast(docs.schema[length_col].dataType) if length_col in docs.columns else None}
    return clean.select(*((new[c] if c in new else F.col("carried").getField(c)).alias(c) for c in docs.columns))
