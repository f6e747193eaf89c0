"""URL filters: host and path rules, and gradient-boosted trees on lexical features for the URLs that no rule fits.

Features and predictions are column expressions. URLs that a rule fits are the labelled ones. Statistics of suffixes and first segments count
all of them; the trees are fitted on the driver to at most TRAIN_ROWS of them, chosen by hash, a bound that does not grow with the data.

Defined results for odd input: host and path of a null URL, or one without ``://``, are empty, and the trees judge it as they
find it; ids may be null or repeated; further columns are ignored; with no labelled URL, or one class only, the trees say
what all the labels say, else allow.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

#: (verdict, host and path) in the form of the result.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
#: Labelled URLs that the trees are fitted to, at most.
TRAIN_ROWS = 4096
TREES, DEPTH, RATE, BINS, LEAST_ROWS, RIDGE = 24, 3, 0.3, 32, 8, 1.0
#: Suffixes (or first segments) whose statistics are sent to all executors; more are joined by a shuffle.
BROADCAST_SUFFIXES = 10_000
FEATURES = ("length", "depth", "digit_ratio", "entropy", "n_params", "host_labels", "path_length", "suffix_rate", "suffix_count", "head_rate", "head_count")
#: Parts of a URL that have statistics: the host's last label (and whether the path ends in .html), and the path's first segment.
PARTS = ("suffix", "head")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """(the longest rule that fits, its verdict), null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def lexical(pages: DataFrame) -> DataFrame:
    """pages(url, host, path, ...) with the features that need no statistics, and the PARTS that have some."""
    url = F.coalesce(F.col("url"), F.lit(""))
    size = F.greatest(F.length(url), F.lit(1)).cast("double")
    counts = F.transform(F.array_distinct(F.split(url, "")), lambda c: F.length(url) - F.length(F.replace(url, c, F.lit(""))))
    shares = F.transform(F.filter(counts, lambda n: n > 0), lambda n: n / size)
    return pages.withColumns(
        {
            "length": F.length(url).cast("double"),
            "depth": F.length("path").cast("double") - F.length(F.translate("path", "/", "")),
            "digit_ratio": (F.length(url) - F.length(F.translate(url, "0123456789", ""))) / size,
            "entropy": F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p)),
            "n_params": (F.length(url) - F.length(F.translate(url, "?&;", ""))).cast("double"),
            "host_labels": F.size(F.split("host", "\\.")).cast("double"),
            "path_length": F.length("path").cast("double"),
            "suffix": F.concat(F.substring_index("host", ".", -1), F.lit("/"), F.element_at(F.split("path", "/"), -1).endswith(".html").cast("string")),
            "head": F.substring_index(F.expr("substring(path, 2)"), "/", 1),
        }
    )


class Trees:
    """Boosted regression trees for log odds, fitted in plain Python on a bounded sample."""

    def __init__(self, rows: list[tuple[list[float], int]]):
        yes = sum(y for _, y in rows)
        share = min(max(yes / len(rows), 1e-4), 1 - 1e-4) if rows else 1e-4
        self.base, self.trees = math.log(share / (1 - share)), []
        if not 0 < yes < len(rows):
            return
        self.cuts = [self._cuts(sorted(x[j] for x, _ in rows)) for j in range(len(rows[0][0]))]
        places = [[sum(v > c for c in self.cuts[j]) for j, v in enumerate(x)] for x, _ in rows]
        score = [self.base] * len(rows)
        for _ in range(TREES):
            chance = [1 / (1 + math.exp(-s)) for s in score]
            slope = [y - p for (_, y), p in zip(rows, chance)]
            bend = [p * (1 - p) for p in chance]
            self.trees.append(self._grow(list(range(len(rows))), places, slope, bend, score, DEPTH))

    @staticmethod
    def _cuts(values: list[float]) -> list[float]:
        picked = {values[len(values) * k // BINS] for k in range(1, BINS)}
        return sorted(c for c in picked if c < values[-1])

    def _grow(self, rows, places, slope, bend, score, depth):
        g, h = sum(slope[i] for i in rows), sum(bend[i] for i in rows)
        best = None
        for j, cuts in enumerate(self.cuts if depth else ()):
            bins = [[0.0, 0.0, 0] for _ in range(len(cuts) + 1)]
            for i in rows:
                cell = bins[places[i][j]]
                cell[0] += slope[i]
                cell[1] += bend[i]
                cell[2] += 1
            left_g = left_h = left_n = 0
            for k in range(len(cuts)):
                left_g, left_h, left_n = left_g + bins[k][0], left_h + bins[k][1], left_n + bins[k][2]
                if min(left_n, len(rows) - left_n) >= LEAST_ROWS:
                    gain = left_g**2 / (left_h + RIDGE) + (g - left_g) ** 2 / (h - left_h + RIDGE) - g * g / (h + RIDGE)
                    if gain > 1e-6 and (best is None or gain > best[0]):
                        best = gain, j, k
        if best is None:
            step = RATE * g / (h + RIDGE)
            for i in rows:
                score[i] += step
            return step
        _, j, k = best
        sides = [i for i in rows if places[i][j] <= k], [i for i in rows if places[i][j] > k]
        return j, self.cuts[j][k], *(self._grow(side, places, slope, bend, score, depth - 1) for side in sides)

    def score(self) -> Column:
        """Log odds of "block" as an expression over the feature columns."""

        def branch(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            j, cut, low, high = node
            return F.when(F.col(FEATURES[j]) <= cut, branch(low)).otherwise(branch(high))

        total = F.lit(self.base)
        for tree in self.trees:
            total = total + branch(tree)
        return total


def part_counts(judged: DataFrame, part: str) -> DataFrame:
    """(part, its n_blocked, its n_labelled) over all labelled rows of lexical(), with labels in ``verdict``."""
    blocked = F.sum((F.col("verdict") == "block").cast("long")).alias(f"{part}_blocked")
    return judged.where("verdict is not null").groupBy(part).agg(blocked, F.count("*").alias(f"{part}_labelled"))


def _part_features(prior: float, total: int, own: Column | None = None) -> dict[str, Column]:
    """Rate (with the prior counted as 4 rows) and share of a row's parts among the labelled; own: a label left out of its own."""
    out = {}
    for part in PARTS:
        blocked, labelled = (F.coalesce(f"{part}_{c}", F.lit(0)) for c in ("blocked", "labelled"))
        if own is not None:
            blocked, labelled = blocked - own, labelled - 1
        out[f"{part}_rate"] = (blocked + F.lit(4 * prior)) / (labelled + F.lit(4))
        out[f"{part}_count"] = labelled / F.lit(float(max(total, 1)))
    return out


def trained(judged: DataFrame, counts: dict[str, DataFrame], train_rows: int = TRAIN_ROWS) -> tuple[Trees, float, int]:
    """Trees, prior and number of labelled rows. Trees are fitted to at most train_rows labelled rows, chosen by hash; the
    statistics in counts (by part) are of all labelled rows, and a row does not count in its own."""
    sums = counts[PARTS[0]].agg(F.sum(f"{PARTS[0]}_blocked").alias("y"), F.sum(f"{PARTS[0]}_labelled").alias("n")).first()
    blocked, total = sums.y or 0, sums.n or 0
    prior = (blocked + 1) / (total + 2)
    own = (F.col("verdict") == "block").cast("int")
    labelled = judged.where("verdict is not null")
    if total > train_rows:
        # A task sends its share of a bounded sample, not train_rows of its own.
        chance = int(min(1.0, 0.9 * train_rows / total) * (1 << 40))
        labelled = labelled.where(F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 40)) < F.lit(chance))
    labelled = _with_counts(labelled, counts).withColumns(_part_features(prior, total, own))
    chosen = labelled.orderBy(F.xxhash64("page_id", "url"), "url").limit(train_rows)
    rows = chosen.select(own.alias("y"), *FEATURES).collect()
    return Trees([([getattr(r, f) for f in FEATURES], r.y) for r in rows]), prior, total


def _with_counts(judged: DataFrame, counts: dict[str, DataFrame]) -> DataFrame:
    for part, known in counts.items():
        judged = judged.join(F.broadcast(known) if known.count() <= BROADCAST_SUFFIXES else known, part, "left")
    return judged


def fitted(judged: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[Trees, dict[str, Column]]:
    """Trees and part statistics as column expressions, for labelled rows with at most BROADCAST_SUFFIXES of each part."""
    counts = {part: written(part_counts(judged, part), part) for part in PARTS}
    trees, prior, total = trained(judged, counts, train_rows)
    features = {}
    for part, known in counts.items():
        rows = known.limit(BROADCAST_SUFFIXES + 1).collect()
        if len(rows) > BROADCAST_SUFFIXES:
            raise ValueError(f"over {BROADCAST_SUFFIXES} values of {part}: join part_counts() instead")
        rate, share = F.lit(prior), F.lit(0.0)
        for value, blocked, labelled in rows:
            rate = F.when(F.col(part) == value, (blocked + 4 * prior) / (labelled + 4)).otherwise(rate)
            share = F.when(F.col(part) == value, labelled / max(total, 1)).otherwise(share)
        features |= {f"{part}_rate": rate, f"{part}_count": share}
    return trees, features


def url_verdicts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_score) for each row of pages. No shuffle but of the parts'
    counts; the trees are fitted to at most train_rows labelled rows."""
    url = F.col(url_col)
    named = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    judged = lexical(named.withColumns({"rule": rule, "verdict": verdict}))
    counts = {part: written(part_counts(judged, part), part) for part in PARTS}
    trees, prior, total = trained(judged, counts, train_rows)
    scored = _with_counts(judged, counts).withColumns(_part_features(prior, total)).withColumn("block_score", trees.score())
    says = F.coalesce("verdict", F.when(F.col("block_score") > 0, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", says.alias("verdict"), "block_score")
