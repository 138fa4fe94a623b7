"""URL filter: rules first, gradient-boosted trees on lexical features for the rest.

A rule is ``host/path`` with a verdict. It fits its host and all subdomains where the url's path starts with
the rule's; the longest rule wins, and of equal ones ``block``. Urls that a rule decides are the
labelled urls from which the trees learn, unless other labels are given.

The trees are grown on histograms: for each level of a tree one aggregation sums the gradients by
(leaf, feature, bin), and the driver reads those few sums (at most leaves * features * bins rows) to choose the
splits. Gradients are whole numbers, so sums don't depend on their order and reruns agree. The
finished trees are a CASE expression that runs in generated code. Training uses at most about
``bound`` different labelled urls, drawn by a hash of the url, each weighing as often as it occurs; scoring covers every row.

Features: url length, path depth, digits in thousands of the length, entropy of the characters, number of
query parameters, host labels, hyphens, and the smoothed share of blocked urls among the labelled ones for each of ``KEYS``: the host's last one and
two labels, the first segment of the path, and these together, down to the first character of the second segment. While the trees are trained, a url's share is that of the
other parts of the labelled urls (``FOLDS``, by hash), so no url sees its own label, and each is learnt from a second time without some of its keys (``MASKED``), whose shares are then
those of all, like an unknown url's. The share tables have at most a row a training url, and only
so are broadcast.

The last part is held back: its urls decide how many of the trees are kept, by their loss, and from what score on a url is blocked, by their errors.

DataFrame functions only.

Defined cases: a null url, or one without ``://``, has empty host and path, fits no rule and is scored
like any other; empty host labels count as labels; repeated rows are judged alike; with no
labelled urls, or of one verdict only, the answer is that verdict, or ``allow``; an empty table
gives no rows; other columns pass through ``judge``, except those named like one that it adds.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, checkpointed

Rule = tuple[str, str]
ALLOW, BLOCK = "allow", "block"
#: What shares of blocked urls are taken by.
KEYS = ("suffix1", "suffix2", "segment", "place1", "place2", "place3")
FEATURES = ("length", "depth", "digits", "entropy", "params", "labels", "hyphens", *KEYS)
#: What copies of training rows don't know.
MASKED = (("place3",), ("place2", "place3"), ("place1", "place2", "place3"), ("segment", "place1", "place2", "place3"), KEYS)
BOUND, TREES, DEPTH, BINS, RATE, L2, SMOOTH, PARTS = 20_000, 12, 3, 16, 0.4, 1.0, 2.0, 8
#: Whole-number gradients: so many to one.
UNIT = 1_000_000
FOLDS = 4


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 1)), F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 2)


def match_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The winning rule and its verdict, or nulls. For rule lists that fit in a plan."""
    rule = verdict = None
    for text, what in sorted(set(rules), key=lambda r: (-len(r[0]), r[1] != BLOCK, r[0])):
        name, slash, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls(url_host, url_path)`` with ``url_rule`` and ``url_rule_verdict`` for rules ``(rule, verdict)`` of any number.

    Each url meets only the rules of its own host and parent domains, by an equi-join on the host. Urls
    are made distinct by (host, path) first, and a hot host's rows are split by Spark.
    """
    keys = urls.select("url_host", "url_path").distinct()
    hosts = F.transform(
        F.sequence(F.lit(1), F.size(F.split("url_host", r"\."))),
        lambda k: F.array_join(F.slice(F.split("url_host", r"\."), k, F.size(F.split("url_host", r"\."))), "."),
    )
    r = rules.select(F.substring_index("rule", "/", 1).alias("suffix"), F.expr("substring(rule, instr(rule, '/'))").alias("start"), "rule", "verdict").distinct()
    found = (
        keys.withColumn("suffix", F.explode(hosts))
        .join(r, "suffix")
        .where(F.startswith("url_path", "start"))
        .groupBy("url_host", "url_path")
        .agg(F.max(F.struct(F.length("rule").alias("n"), F.col("verdict") == BLOCK, "rule", "verdict")).alias("m"))
        .select("url_host", "url_path", F.col("m.rule").alias("url_rule"), F.col("m.verdict").alias("url_rule_verdict"))
    )
    return urls.join(found, ["url_host", "url_path"], "left")


def _lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    text = F.coalesce(url, F.lit(""))
    n = F.char_length(text)
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    share = lambda c: (n - F.char_length(F.replace(text, c, F.lit("")))) / n
    chars = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    return {
        "length": n.cast("double"),
        "depth": F.regexp_count(path, F.lit("/[^/]+")).cast("double"),
        "digits": F.floor(1000 * (n - F.char_length(F.translate(text, "0123456789", ""))) / F.greatest(n, F.lit(1))).cast("double"),
        "entropy": F.round(F.aggregate(chars, F.lit(0.0), lambda s, c: s - share(c) * F.log(share(c))), 4),
        "params": F.regexp_count(query, F.lit("[^&;]+")).cast("double"),
        "labels": F.size(F.split(host, r"\.")).cast("double"),
        "hyphens": (F.char_length(host) - F.char_length(F.replace(host, F.lit("-"), F.lit("")))).cast("double"),
    }


def _with_features(urls: DataFrame) -> DataFrame:
    lexical = _lexical(F.col("url_url"), F.col("url_host"), F.col("url_path"))
    last, two = (F.substring_index("url_host", ".", -k) for k in (1, 2))
    part = lambda k: F.regexp_extract("url_path", r"^/([^/]*)(?:/([^/]?))?", k)
    keys = dict(zip(KEYS, (last, two, part(1), F.concat_ws("/", last, part(1)), F.concat_ws("/", two, part(1)), F.concat_ws("/", two, part(1), part(2))), strict=True))
    return urls.select("*", *(c.alias(f"url_f_{k}") for k, c in lexical.items()), *(c.alias(f"url_s_{k}") for k, c in keys.items()))


@dataclass
class Model:
    """Trees over binned features: ``trees`` are nested (feature, threshold, left, right) or leaf values."""

    prior: float = 0.0
    prior_share: float = 0.0
    trees: list = field(default_factory=list)
    shares: dict[str, DataFrame] = field(default_factory=dict)
    only: str | None = ALLOW
    threshold: float = 0.5

    def margin(self) -> Column:
        return reduce(lambda a, t: a + _walk(t), self.trees, F.lit(self.prior))


def _walk(t: object) -> Column:
    """What a tree adds to a row's margin."""
    if not isinstance(t, tuple):
        return F.lit(float(t))
    f, cut, left, right = t
    return F.when(F.col(f"url_f_{f}") <= cut, _walk(left)).otherwise(_walk(right))


def _add_shares(featured: DataFrame, model: Model) -> DataFrame:
    for k, table in model.shares.items():
        featured = featured.join(F.broadcast(table), f"url_s_{k}", "left").withColumn(f"url_f_{k}", F.coalesce(f"url_f_{k}", F.lit(model.prior_share)))
    return featured


def train(labelled: DataFrame, bound: int = BOUND, trees: int = TREES, depth: int = DEPTH) -> Model:
    """Fit on ``labelled(url_url, url_host, url_path, url_label)``, label being true for blocked urls."""
    labelled = labelled.groupBy("url_url", "url_host", "url_path", "url_label").agg(F.count("*").alias("url_weight"))
    counted = labelled.agg(F.count("*").alias("n"), F.count_if("url_label").alias("bad")).first()
    if counted["n"] == 0 or counted["bad"] in (0, counted["n"]):
        return Model(only=BLOCK if counted["n"] and counted["bad"] else ALLOW)
    part = min(1.0, bound / counted["n"])
    drawn = labelled.where(F.pmod(F.xxhash64("url_url"), F.lit(1 << 30)) < int(part * (1 << 30))) if part < 1 else labelled
    part_of = F.pmod(F.xxhash64(F.lit(1), "url_url"), F.lit(FOLDS)).alias("url_fold")
    # From here on all tables are bounded, and a few partitions hold them.
    sample = checkpointed(_with_features(drawn).select("*", part_of).drop("url_url", "url_host", "url_path").coalesce(PARTS))
    bad = F.sum(F.when(F.col("url_label"), F.col("url_weight")).otherwise(0))
    seen = sample.agg(F.sum("url_weight").alias("n"), bad.alias("bad")).first()
    if not seen["n"] or seen["bad"] in (0, seen["n"]):
        return Model(only=BLOCK if seen["n"] and seen["bad"] else ALLOW)
    model, share = Model(only=None), seen["bad"] / seen["n"]
    model.prior_share = round(share, 6)
    smoothed = lambda bad, n: F.round((bad + SMOOTH * share) / (n + SMOOTH), 6)
    rows = sample
    for k in KEYS:
        key = f"url_s_{k}"
        counts = checkpointed(sample.groupBy(key, "url_fold").agg(bad.alias("bad"), F.sum("url_weight").alias("n")).coalesce(PARTS))
        sums = counts.groupBy(key).agg(F.sum("bad").alias("all_bad"), F.sum("n").alias("all_n"))
        model.shares[k] = checkpointed(sums.select(key, smoothed(F.col("all_bad"), F.col("all_n")).alias(f"url_f_{k}")).coalesce(PARTS))
        others = counts.join(sums, key).select(key, "url_fold", smoothed(F.col("all_bad") - F.col("bad"), F.col("all_n") - F.col("n")).alias(f"url_f_{k}"))
        rows = rows.join(F.broadcast(others), [key, "url_fold"])
    # A copy of each row without some of its keys tells what a url of unknown places is like.
    shares = [f"url_f_{k}" for k in KEYS]
    masked = F.pmod(F.xxhash64(F.lit(2), *(f"url_s_{k}" for k in KEYS), "url_f_length"), F.lit(len(MASKED)))
    hide = lambda k: reduce(lambda a, m: a | ((masked == m) & F.lit(k in MASKED[m])), range(len(MASKED)), F.lit(False))
    rows = checkpointed(rows.select("url_label", "url_weight", "url_fold", *(c for c in rows.columns if c.startswith("url_f_") and c not in shares), *shares, masked.alias("masked")))
    masked = F.col("masked")
    hidden = rows.withColumns({f"url_f_{k}": F.when(hide(k), F.lit(model.prior_share)).otherwise(F.col(f"url_f_{k}")) for k in KEYS})
    rows = rows.unionByName(hidden)
    steps = [F.lit(k / BINS) for k in range(1, BINS)]
    cuts = rows.agg(*(F.array_distinct(F.percentile(F.col(f"url_f_{f}"), F.array(*steps))).alias(f) for f in FEATURES)).first()
    cuts = {f: sorted(cuts[f]) for f in FEATURES}

    def bin_of(f: str) -> Column:
        return F.array_size(F.filter(F.array(*map(F.lit, cuts[f])), lambda c: F.col(f"url_f_{f}") > c))

    held = (F.col("url_fold") == FOLDS - 1).alias("held")
    rows = rows.select("url_label", "url_weight", held, F.lit(model.prior).alias("margin"), *(f"url_f_{f}" for f in FEATURES), F.array(*map(bin_of, FEATURES)).alias("bins"))
    rows = checkpointed(rows.coalesce(PARTS))
    learnt = rows.where("NOT held")
    for _ in range(trees):
        model.trees.append(_grow(learnt, cuts, depth))
        learnt = checkpointed(learnt.withColumn("margin", F.col("margin") + _walk(model.trees[-1])))
    _settle(rows.where("held"), model)
    return model


def _settle(held: DataFrame, model: Model) -> None:
    """Keep as many trees as do best on the rows held back, and the threshold that errs least on them: two jobs, whose sums the driver reads."""
    sign = F.when(F.col("url_label"), -1.0).otherwise(1.0)
    margins = [F.lit(model.prior)]
    for t in model.trees:
        margins.append(margins[-1] + _walk(t))
    loss = lambda m: F.round(F.sum(F.round(F.log1p(F.exp(sign * m)) * UNIT).cast("long") * F.col("url_weight"))).cast("long")
    sums = held.agg(*(loss(m).alias(f"l{k}") for k, m in enumerate(margins))).first()
    if sums["l0"] is None:
        return
    model.trees = model.trees[: min(range(len(margins)), key=lambda k: (sums[f"l{k}"], k))]
    step = F.floor(100 / (1 + F.exp(-model.margin())))
    counts = {(r["step"], r["url_label"]): r["n"] for r in held.groupBy(step.alias("step"), "url_label").agg(F.sum("url_weight").alias("n")).collect()}
    # Blocked are the scores from a hundredth on; of thresholds that err alike the one nearest to a half.
    errors = lambda t: sum(n for (k, bad), n in counts.items() if (k >= t) != bad)
    model.threshold = min(range(1, 101), key=lambda t: (errors(t), abs(t - 50), t)) / 100


def _grow(rows: DataFrame, cuts: dict[str, list[float]], depth: int) -> object:
    """One more tree for ``rows(url_label, url_weight, margin, bins)``: per level, one aggregation of gradients by (leaf, feature, bin)."""
    p = 1 / (1 + F.exp(-F.col("margin")))
    g = F.round((F.col("url_label").cast("int") - p) * UNIT).cast("long") * F.col("url_weight")
    h = F.round(p * (1 - p) * UNIT).cast("long") * F.col("url_weight")
    splits: dict[int, tuple[int, float]] = {}
    places: dict[int, tuple[int, int]] = {}
    sums: dict[int, tuple[int, int]] = {}
    leaves = {1}
    for level in range(depth + 1):
        leaf = _leaf(1, places)
        cells = rows.select(leaf.alias("leaf"), g.alias("g"), h.alias("h"), F.posexplode("bins").alias("f", "b")).groupBy("leaf", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
        by: dict[tuple[int, int], dict[int, tuple[int, int]]] = {}
        for c in cells:
            by.setdefault((c["leaf"], c["f"]), {})[c["b"]] = (c["g"], c["h"])
        for k in leaves:
            if first := by.get((k, 0)):
                sums[k] = tuple(map(sum, zip(*first.values(), strict=True)))
        if level == depth:
            break
        gain = lambda a, b: a * a / (b + L2 * UNIT)
        grown = set()
        for k in sorted(leaves & sums.keys()):
            (tg, th), best = sums[k], None
            for f, name in enumerate(FEATURES):
                lg = lh = 0
                for b, cut in enumerate(cuts[name]):
                    x = by[k, f].get(b, (0, 0))
                    lg, lh = lg + x[0], lh + x[1]
                    got = gain(lg, lh) + gain(tg - lg, th - lh) - gain(tg, th)
                    if got > 1e-3 * UNIT and (best is None or got > best[0]):
                        best = (got, f, cut, b)
            if best:
                splits[k], places[k] = best[1:3], (best[1], best[3])
                grown |= {2 * k, 2 * k + 1}
        leaves = grown
        if not leaves:
            break

    def build(k: int) -> object:
        if k in splits:
            f, cut = splits[k]
            return FEATURES[f], cut, build(2 * k), build(2 * k + 1)
        tg, th = sums.get(k, (0, 0))
        return round(RATE * tg / (th + L2 * UNIT), 9)

    return build(1)


def _leaf(k: int, places: dict[int, tuple[int, int]]) -> Column:
    """The leaf of a row, by its bins."""
    if k not in places:
        return F.lit(k)
    f, b = places[k]
    return F.when(F.get("bins", F.lit(f)) <= b, _leaf(2 * k, places)).otherwise(_leaf(2 * k + 1, places))


def judge(urls: DataFrame, rules: list[Rule], url: str = "url", labelled: DataFrame | None = None) -> DataFrame:
    """``urls`` with ``url_host``, ``url_path``, ``url_rule``, ``url_score`` (of being blocked) and ``url_verdict``.

    ``labelled(url, blocked)`` are the urls to learn from; without it those that a rule decides.
    """

    def parsed(df: DataFrame, c: str) -> DataFrame:
        host, path = split_url(F.col(c))
        return df.select(F.struct("*").alias("url_row"), F.col(c).alias("url_url"), host.alias("url_host"), path.alias("url_path"))

    rows = parsed(urls, url)
    rule, verdict = match_rule(F.col("url_host"), F.col("url_path"), rules)
    if labelled is None:
        known = rows.select("url_url", "url_host", "url_path", verdict.alias("v")).where("v IS NOT NULL").withColumn("url_label", F.col("v") == BLOCK).drop("v")
    else:
        known = parsed(labelled, "url").select("url_url", "url_host", "url_path", F.col("url_row")["blocked"].alias("url_label"))
    model = train(known)
    rows = rows.select("*", rule.alias("url_rule"), verdict.alias("url_rule_verdict"))
    if model.only:
        score = F.lit(1.0 if model.only == BLOCK else 0.0)
    else:
        rows = _add_shares(_with_features(rows), model)
        score = 1 / (1 + F.exp(-model.margin()))
    rows = rows.withColumn("url_score", score)
    rows = rows.withColumn("url_verdict", F.coalesce("url_rule_verdict", F.when(F.col("url_score") >= model.threshold, BLOCK).otherwise(ALLOW)))
    added = ("url_host", "url_path", "url_rule", "url_score", "url_verdict")
    return rows.select(*(F.col("url_row")[c].alias(c) for c in urls.columns if c not in added), *added)
