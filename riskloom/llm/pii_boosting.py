"""Personal data in texts: base patterns, and spans that boosted trees add out of high-recall candidates.

1. Base spans are the leftmost matches of one pattern a kind that pass its check (parts of an address, Luhn
   digits, number of digits). They always stay.
2. Generators propose candidates that overlap freely: addresses with the signs written out or spaced, addresses of
   machines with other dots, and groups of digits, each as a card and as a telephone number.
3. Each candidate has features of its format (digits, groups, separators, checks, labels) and of its context (cues
   before it, the characters around it, digits nearby).
4. Labels come from the data: candidates in base form are positive, those that fail a check are negative,
   and what is neither is not learnt from. Positives are also learnt from in other forms (signs written out,
   dots between groups, no leading plus) and, with their check broken, as negatives. All candidates of all
   documents are counted by feature values; trees are boosted on the counts of at most ``max_patterns`` of these
   patterns, drawn by a hash, the only sample taken.
5. A fifth of the documents is held back; there the scores are calibrated by monotonic regression for each kind,
   and the least score whose calibrated precision reaches ``precision`` is the kind's threshold. A kind without such
   a score gets no spans.
6. Of accepted candidates that overlap one another the best scored is added, unless a base span is among them.

All that touches rows is DataFrame functions; matches' places are running sums of the lengths of gaps and matches. Only the
bounded sample of patterns and the calibration's histogram reach the driver. Texts are read once and never shuffled.

Defined results: a null or empty text has no spans; repeated rows and ids give a row each; a null id stays null;
an empty table gives no rows; without any positives nothing is added; other columns are ignored. Places are code points.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.llm.common import cut
from riskloom.operators import growing
from riskloom.operators.models import Boosting, FeaturePreparer

KINDS = ("email", "ip", "card", "phone")

# The base patterns. Their repeats give nothing back, and a local part or number is begun at its first
# character or where the match before has ended, so that long runs take linear time and no deep recursion.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT = r"(?:\s?@\s?|\s?[(\[{<]\s?(?:at|AT)\s?[)\]}>]\s?|\s(?:at|AT)\s)"
_DOT = r"(?:\s?\.\s?|\s?[(\[{<]\s?(?:dot|DOT|\.)\s?[)\]}>]\s?|\s(?:dot|DOT)\s)"
#: Generators and the kinds that each match of theirs is a candidate of.
GENERATORS = (
    (rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,4}}", (0,)),
    (rf"(?<![0-9.])[0-9]{{1,4}}(?:{_DOT}[0-9]{{1,4}}){{3}}(?![0-9])", (1,)),
    (r"(?<![0-9])(?:\+\s?)?\(?[0-9](?:[\x20().\-/\u00A0]{0,3}[0-9]){8,24}+(?![0-9])", (2, 3)),
    (r"(?<![0-9])(?:[0-9]{9,19}|[0-9]{4}(?:[\x20.\-][0-9]{4}){2,3})(?![0-9])", (2, 3)),
    (r"\+[0-9]{1,3}[\x20.\-]?\(?[0-9]{2,4}\)?[\x20.\-]?[0-9]{3,4}[\x20.\-]?[0-9]{3,4}(?![0-9])", (3,)),
)
#: What the texts that hold a match must hold, looked for first.
NEEDS = ("@", "[0-9]", "[0-9]", r"\+", r"@|(?i:\bat\b)", "[0-9]", "[0-9]", "[0-9]", r"\+")

# Words before a span that tell its kind, and words that tell another number.
CUES = {
    0: r"(?:e-?mail|mailto|contact|courriel|correo|write|kontakt)",
    1: r"(?:\bip\b|host|server|address|addr|serveur|client|peer)",
    2: r"(?:card|visa|master|amex|credit|carte|karte|tarjeta|pan\b)",
    3: r"(?:tel|phone|call|mobile|fax|cell|whatsapp|telefon|tel[eé]fono|t[eé]l[eé]phone)",
}
OTHER_CUES = r"(?:order|invoice|isbn|version|\bv\b|\bid\b|\bno\b|number|serial|ref|total|date|price|[#$€£=_/:])"

CONTEXT = 40
TREES = {"n_trees": 16, "depth": 3, "learning_rate": 0.5, "min_leaf": 2, "ridge": 1.0, "max_bins": 32}
FEATURES = (
    "x_kind", "x_digits", "x_luhn", "x_groups", "x_longest", "x_shortest", "x_plus", "x_paren", "x_space", "x_hyphen", "x_dot", "x_slash", "x_at", "x_dots", "x_labels", "x_tld",
    "x_range", "x_local", "x_cue", "x_other", "x_before", "x_after", "x_dense",
)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the sum of the digits, every second from the right doubled (less 9 over 9), is divisible by ten."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d: F.coalesce(d.try_cast("int"), F.lit(0)))
    counted = F.transform(each, lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(counted, F.lit(0), lambda a, x: a + x) % 10 == 0


def _in_range(m: Column) -> Column:
    """Whether all groups of digits are at most 255."""
    return F.forall(F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0)), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))


def passes(kind: Column, m: Column) -> Column:
    """Whether a match of a kind's base pattern passes its check; checks of digits are only made on their length."""
    n, digits = F.length(_digits(m)), _digits(m)
    card = F.when(n.between(14, 19), luhn(digits)).otherwise(False)
    return F.when(kind == 0, True).when(kind == 1, _in_range(m)).when(kind == 2, card).otherwise(n.between(10, 15))


def matches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row_, doc_id, found): all matches of all patterns of a text with the lengths of the gaps before them and their surroundings, evaluated once."""
    patterns = [*BASE.values(), *(p for p, _ in GENERATORS)]
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(F.monotonically_increasing_id().alias("row_"), F.col(id_col).cast("long").alias("doc_id"), text.alias("t"))
    for k, (p, need) in enumerate(zip(patterns, NEEDS, strict=True)):
        read = read.withColumn(f"m{k}", F.when(F.col("t").rlike(need), F.regexp_extract_all("t", F.lit(p), F.lit(0))).otherwise(F.array().cast("array<string>")))
    for k, p in enumerate(patterns):
        read = read.withColumn(f"g{k}", F.when(F.size(f"m{k}") > 0, F.split("t", p, -1)))
    return cut(read.select("row_", "doc_id", F.concat(*[F.transform(f"m{k}", _match(k)) for k in range(len(patterns))]).alias("found")))


def _match(k: int):
    """A function of a match of pattern k and its number that gives what is kept of it."""

    def one(m: Column, i: Column) -> Column:
        gap, following = F.get(f"g{k}", i), F.get(f"g{k}", i + 1)
        near = (F.lit(""), F.lit("")) if k < len(KINDS) else (F.right(gap, F.lit(CONTEXT)), F.left(following, F.lit(CONTEXT // 2)))
        return F.struct(F.lit(k).alias("p"), i.alias("i"), F.length(gap).alias("gap"), m.alias("m"), near[0].alias("before"), near[1].alias("after"))

    return one


def placed(found: DataFrame) -> DataFrame:
    """A row for each match: row_, p, m, before, after, start and end."""
    rows = found.select("row_", F.explode("found").alias("f")).select("row_", "f.*")
    end = F.sum(F.col("gap") + F.length("m")).over(W.partitionBy("row_", "p").orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("m"))


def _class(c: Column) -> Column:
    """0 nothing, 1 white space, 2 letter, 3 digit, 4 other."""
    return F.when(c == "", 0).when(c.rlike(r"^\s$"), 1).when(c.rlike(r"^\p{L}$"), 2).when(c.rlike("^[0-9]$"), 3).otherwise(4)


def featured(rows: DataFrame) -> DataFrame:
    """Add the features of (kind, m, before, after): small whole numbers."""
    m, kind = F.col("m"), F.col("kind")
    flag = lambda c: c.cast("int")
    rows = rows.withColumns({"d_": _digits(m), "runs_": F.transform(F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0)), lambda g: F.length(g)), "labels_": F.split(F.regexp_replace(m, rf"^.*?{_AT}", ""), _DOT, -1)})
    mail = kind == 0
    number = kind != 0
    at = F.when(m.contains("@"), 1).when(m.rlike(r"[(\[{<]\s?(?:at|AT)\s?[)\]}>]"), 2).otherwise(3)
    dots = F.when(m.rlike(r"\s(?:dot|DOT)\s"), 3).when(m.rlike(r"[(\[{<]\s?(?:dot|DOT|\.)\s?[)\]}>]"), 2).when(m.rlike(r"\.\s|\s\."), 4).when(m.contains("."), 1).otherwise(0)
    last = F.element_at("labels_", -1)
    cue = reduce(lambda a, k: a.when(kind == k, F.lower("before").rlike(CUES[k])), list(CUES)[1:], F.when(kind == 0, F.lower("before").rlike(CUES[0])))
    near = F.concat("before", F.lit(" "), "after")
    zero = F.lit(0)
    made = {
        "x_kind": kind, "x_digits": F.least(F.length("d_"), F.lit(26)), "x_luhn": F.when(F.length("d_").between(12, 19), flag(luhn(F.col("d_")))).otherwise(zero), "x_groups": F.least(F.size("runs_"), F.lit(12)),
        "x_longest": F.coalesce(F.array_max("runs_"), zero), "x_shortest": F.coalesce(F.array_min("runs_"), zero), "x_plus": flag(m.startswith("+")), "x_paren": flag(m.contains("(")), "x_space": flag(m.contains(" ")),
        "x_hyphen": flag(number & m.contains("-")), "x_dot": flag(number & m.contains(".")), "x_slash": flag(number & m.contains("/")), "x_at": F.when(mail, at).otherwise(zero), "x_dots": F.when(mail | (kind == 1), dots).otherwise(zero),
        "x_labels": F.when(mail, F.size("labels_")).otherwise(zero), "x_tld": F.when(mail & last.rlike("^[A-Za-z]+$"), F.least(F.length(last), F.lit(12))).otherwise(zero), "x_range": flag((kind == 1) & _in_range(m)),
        "x_local": F.when(mail, F.when(m.rlike(r"^[^@(\[{<\s]*[0-9._+-]"), 2).otherwise(1)).otherwise(zero), "x_cue": flag(cue), "x_other": flag(F.lower("before").rlike(OTHER_CUES + r"\W{0,3}$")),
        "x_before": _class(F.right("before", F.lit(1))), "x_after": _class(F.left("after", F.lit(1))), "x_dense": F.least(F.length(_digits(near)), F.lit(15)),
    }
    return rows.withColumns({k: F.coalesce(v.cast("int"), zero) for k, v in made.items()}).drop("d_", "runs_", "labels_")


_DATE = r"^\(?(?:19|20)[0-9]{2}[-./\x20][01]?[0-9][-./\x20][0-3]?[0-9]|^\(?[0-3]?[0-9][-./][0-3]?[0-9][-./](?:19|20)[0-9]{2}"

#: What looks like the address of a machine is no telephone number.
_FOUR_PARTS = r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"


def labelled(rows: DataFrame) -> DataFrame:
    """``rows`` with ``label``: 1 in base form, 0 if a check fails, null if neither."""
    m, kind, n = F.col("m"), F.col("kind"), F.col("x_digits")
    whole = lambda k: m.rlike(f"^(?:{BASE[k]})$")
    mixed = (F.col("x_at") == 3) & (F.col("x_dots") != 3)
    email = F.when(whole("email") & (F.col("x_tld") >= 2), 1).when((F.col("x_tld") < 2) | mixed | (F.col("x_dots") == 4), 0)
    ip = F.when(F.col("x_range") == 0, 0).when(whole("ip"), 1)
    card = F.when((F.col("x_luhn") == 0) | ~n.between(13, 19), 0).when(whole("card") & (n >= 14), 1)
    phone = F.when(~n.between(10, 15) | m.rlike(_DATE) | m.rlike(_FOUR_PARTS) | ((F.col("x_plus") == 0) & ((F.col("x_groups") < 3) | (F.col("x_longest") > 5))), 0).when(whole("phone"), 1)
    return rows.withColumn("label", F.when(kind == 0, email).when(kind == 1, ip).when(kind == 2, card).otherwise(phone))


def other_forms() -> Column:
    """Array of (m, label) of a positive candidate: written in other ways, and with its check broken."""
    m, kind, d = F.col("m"), F.col("kind"), _digits(F.col("m"))
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    form = lambda x, label: F.struct(x.alias("m"), F.lit(label).alias("label"))
    mail = lambda at, dot: F.concat(local, F.lit(at), F.replace(domain, F.lit("."), F.lit(dot)))
    fours = lambda x, sep: F.regexp_replace(x, "([0-9]{4})(?=[0-9])", f"$1{sep}")
    broken = F.concat(F.expr("left(m, length(m) - 1)"), ((F.right(m, F.lit(1)).try_cast("int") + 1) % 10).cast("string"))
    far = F.concat((F.substring_index(m, ".", 1).try_cast("long") + 300).cast("string"), F.expr("substring(m, instr(m, '.'))"))
    plain = F.expr("ltrim(' +', m)")
    dotted = F.regexp_replace(F.regexp_replace(plain, "[^0-9]+", "."), r"^\.|\.$", "")
    none = F.array().cast("array<struct<m:string,label:int>>")
    grouped = F.size(F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0))) >= 3
    return (
        F.when(kind == 0, F.array(form(mail(" at ", " dot "), 1), form(mail("(at)", "(dot)"), 1), form(mail(" [at] ", " [dot] "), 1), form(mail(" @ ", "."), 1), form(mail(" at ", "."), 0), form(F.regexp_replace(m, r"[^.]+$", "99"), 0)))
        .when(kind == 1, F.array(form(F.replace(m, F.lit("."), F.lit("[.]")), 1), form(F.replace(m, F.lit("."), F.lit(" dot ")), 1), form(F.replace(far, F.lit("."), F.lit("[.]")), 0), form(far, 0)))
        .when(kind == 2, F.array(form(fours(d, "."), 1), form(fours(d, " "), 1), form(fours(_digits(broken), "."), 0), form(fours(_digits(broken), " "), 0), form(broken, 0)))
        .when(kind == 3, F.when(grouped, F.array(form(plain, 1), form(dotted, 1), form(d, 0))).otherwise(F.array(form(d, 0))))
        .otherwise(none)
    )


def counted(candidates: DataFrame) -> DataFrame:
    """How many labelled candidates, other forms of positives included, have the same features, label and part (``held``: kept for calibration)."""
    columns = ["row_", "kind", "m", "before", "after", "label"]
    known = candidates.filter("label IS NOT NULL").select(*columns, *FEATURES)
    written = candidates.filter("label = 1").select("row_", "kind", "before", "after", F.explode(other_forms()).alias("o")).select("row_", "kind", "o.m", "before", "after", "o.label")
    rows = known.unionByName(featured(written))
    held = F.pmod(F.xxhash64("row_"), F.lit(5)) == 0
    return cut(rows.groupBy(*FEATURES, "label", held.alias("held")).agg(F.count("*").cast("double").alias("n")))


def isotonic(cells: Sequence[tuple[int, float, float]]) -> list[tuple[int, float]]:
    """(bin, calibrated share) of cells (bin, positives, all) in order: neighbours that fall are pooled."""
    pools: list[list] = []
    for b, pos, n in sorted(cells):
        pools.append([[b], pos, n])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            bins, p, m = pools.pop()
            pools[-1] = [pools[-1][0] + bins, pools[-1][1] + p, pools[-1][2] + m]
    return [(b, pos / n) for bins, pos, n in pools for b in bins]


def thresholds(model: Boosting, counts: DataFrame, precision: float, steps: int = 100) -> dict[int, float]:
    """For each kind the least score, in steps, whose calibrated share of positives reaches ``precision`` on what was held back."""
    scored = model.predict(counts.filter("held"), "score")
    cells = scored.groupBy("x_kind", F.floor(F.col("score") * steps).cast("int").alias("b")).agg(F.sum(F.col("label") * F.col("n")), F.sum("n")).collect()
    out = {}
    for k in range(len(KINDS)):
        good = [b for b, share in isotonic([(b, p, n) for kind, b, p, n in cells if kind == k]) if share >= precision]
        if good:
            out[k] = min(good) / steps
    return out


def boosted(rows: Sequence[tuple], params: dict) -> Boosting:
    """Boosted trees on patterns (features, label, n), each weighing as many candidates as it was counted for."""
    model = Boosting(**params)
    x = np.array([r[: len(FEATURES)] for r in rows], "i8").reshape(len(rows), len(FEATURES))
    y, n = np.array([r[-2] for r in rows], "f8"), np.array([r[-1] for r in rows], "f8")
    edges = {f: [float(v) for v in np.unique(x[:, k])[:-1]] for k, f in enumerate(FEATURES)}
    model.features, model.preparer = list(FEATURES), FeaturePreparer(list(FEATURES), [], edges=edges)
    bins = np.stack([np.searchsorted(edges[f], x[:, k], "left") + 1 for k, f in enumerate(FEATURES)], axis=1)
    rate = min(max(float((y * n).sum() / n.sum()) if len(rows) else 0.0, 1e-6), 1 - 1e-6)
    model.base_, model.trees_ = math.log(rate / (1 - rate)), []
    margin = np.full(len(rows), model.base_)
    for _ in range(model.params["n_trees"] if len(rows) else 0):
        q = 1 / (1 + np.exp(-margin))
        sums = np.stack([(y - q) * n, np.maximum(q * (1 - q), 1e-6) * n, np.ones(len(rows))])
        tree = growing.Tree(model.params, list(range(len(FEATURES))), set(), model.preparer.width())
        inside = {0: np.ones(len(rows), bool)}
        while wanted := tree.wanted():
            asked, cells = tree.asked(wanted), {}
            for k in asked:
                own = _inside(tree, inside, bins, k)
                count = lambda f, own=own: np.stack([np.bincount(bins[own, f], s[own], tree.bins) for s in sums], axis=1)
                cells[k] = [(f, b, *cell[b]) for f in range(len(FEATURES)) for cell in [count(f)] for b in np.flatnonzero(cell[:, 2])]
            tree.told(asked, cells)
        nodes, _ = tree.finished()
        model.trees_.append(nodes)
        margin = margin + _values(nodes, bins)
    return model


def _inside(tree: growing.Tree, inside: dict[int, np.ndarray], bins: np.ndarray, k: int) -> np.ndarray:
    """The patterns that a node holds."""
    if k not in inside:
        parent = tree.nodes[k]["parent"]
        own, (_, f, rule, _) = _inside(tree, inside, bins, parent), tree.nodes[parent]["split"]
        left = bins[:, f] <= rule["cut"]
        inside[tree.nodes[parent]["left"]], inside[tree.nodes[parent]["right"]] = own & left, own & ~left
    return inside[k]


def _values(nodes: list[dict], bins: np.ndarray) -> np.ndarray:
    out, at = np.zeros(len(bins)), np.zeros(len(bins), "i8")
    for k, node in enumerate(nodes):  # children come after their parents
        own = at == k
        if "left" in node:
            at[own] = np.where(bins[own, node["feature"]] <= node["cut"], node["left"], node["right"])
        else:
            out[own] = node["value"]
    return out


def fitted(counts: DataFrame, precision: float = 0.98, trees: dict | None = None, max_patterns: int = 50_000) -> tuple[Boosting, dict[int, float]]:
    """The boosted trees and the kinds' thresholds. Trees are fitted on at most ``max_patterns`` counted patterns, drawn by a hash; calibration is on all that are held back."""
    rows = counts.filter("NOT held").orderBy(F.xxhash64(*FEATURES, "label"), *FEATURES, "label").limit(max_patterns).select(*FEATURES, "label", "n").collect()
    model = boosted(rows, {**TREES, **(trees or {})})
    return model, thresholds(model, counts, precision)


def chosen(base: DataFrame, accepted: DataFrame) -> DataFrame:
    """(row_, kind, start, end, score): of accepted candidates that overlap one another the best, if no base span is among them."""
    spans = base.select("row_", "kind", "start", "end", F.lit(None).cast("double").alias("score")).union(accepted.select("row_", "kind", "start", "end", "score"))
    along = W.partitionBy("row_").orderBy("start", "end", "kind")
    reach = F.max("end").over(along.rowsBetween(W.unboundedPreceding, -1))
    chained = spans.withColumn("new_", F.coalesce((reach <= F.col("start")).cast("int"), F.lit(1))).withColumn("chain_", F.sum("new_").over(along.rowsBetween(W.unboundedPreceding, 0)))
    chain = W.partitionBy("row_", "chain_")
    ranked = chained.withColumn("free_", F.min(F.col("score").isNotNull()).over(chain)).withColumn("rank_", F.row_number().over(chain.orderBy(F.desc_nulls_last("score"), F.col("start") - F.col("end"), "start", "kind")))
    return ranked.filter("score IS NOT NULL AND free_ AND rank_ = 1").select("row_", "kind", "start", "end", "score")


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = 0.98, trees: dict | None = None, max_patterns: int = 50_000) -> DataFrame:
    """Per row: doc_id and ``spans``, sorted by start and kind: (start, kind, end, score), kind a number in KINDS, score null for base spans."""
    found = matches(docs, id_col, text_col)
    rows = cut(placed(found))
    own = F.array(*[F.array(*[F.lit(k) for k in kinds]) for _, kinds in GENERATORS])
    base = rows.filter(F.col("p") < len(KINDS)).withColumn("kind", F.col("p")).filter(passes(F.col("kind"), F.col("m")))
    proposed = rows.filter(F.col("p") >= len(KINDS)).withColumn("kind", F.explode(F.get(own, F.col("p") - len(KINDS))))
    candidates = cut(labelled(featured(proposed)))
    model, least = fitted(counted(candidates), precision, trees, max_patterns)
    enough = F.coalesce(*[F.when((F.col("kind") == k) & (F.col("score") >= v), True) for k, v in least.items()], F.lit(False))
    accepted = model.predict(candidates, "score").filter(enough)
    shown = lambda df: df.select("row_", F.struct(F.col("start").cast("long").alias("start"), "kind", F.col("end").cast("long").alias("end"), F.col("score").cast("double").alias("score")).alias("s"))
    spans = shown(base.withColumn("score", F.lit(None))).union(shown(chosen(base, accepted)))
    listed = spans.groupBy("row_").agg(F.sort_array(F.collect_list("s")).alias("spans"))
    return found.select("row_", "doc_id").join(listed, "row_", "left").select("doc_id", F.coalesce("spans", F.array().cast("array<struct<start:bigint,kind:int,end:bigint,score:double>>")).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span, or stretch of spans that overlap, replaced by the first one's kind in brackets."""
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))

    def step(a: Column, s: Column) -> Column:
        between = F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))
        return F.struct(F.when(s["start"] >= a["at"], F.concat(a["done"], between, F.get(names, s["kind"]))).otherwise(a["done"]).alias("done"), F.greatest(a["at"], s["end"]).alias("at"))

    return F.aggregate(spans, start, step, lambda a: F.concat(a["done"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))


def _of(kind: int):
    return lambda s: s["kind"] == kind


def digests(found: DataFrame) -> DataFrame:
    """doc_id, base spans by kind, SHA-256 of the base spans, and all spans, as kind:start:end joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    line = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["score"].isNull())
    number = [F.size(F.filter(base, _of(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *number, F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
