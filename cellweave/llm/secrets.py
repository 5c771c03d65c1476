"""Secret scan: regular expressions find candidates, a random forest drops false positives.

The scan runs in DataFrame functions only. The forest is trained in numpy, on
the driver, from labelled findings, and becomes one column expression. Features:
candidate length and composition, transitions between character classes,
coverage by dictionary words, and what the path and the neighbouring words say:
the log-odds, learned from the findings, of each word there among secrets and
among others. While the forest is trained, these come from the half of the
findings that a finding isn't in.
"""

from __future__ import annotations

import base64
import random
import re
import uuid
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a candidate looks like inside a word.
CORE = r"[A-Za-z0-9][A-Za-z0-9+/_.\-]{14,}[A-Za-z0-9=]={0,2}"
DICTIONARY = (
    "access account admin alpha android api apple application array article asset assets author backup bar base basic beta block body branch browser bucket build button cache callback center change chart class client cloud color "
    "column commit common component config connect container content context control copy core count create custom data database date debug default delete demo demos detail device dialog digest display doc docs domain download driver dummy "
    "east edit element email empty enable engine error event example extension factory fake field file filter flag folder font foo form format frame function github group handler header height hello here home host html http https icon image import index info input install instance integer interface internal item java key label language layer layout learn left level library light line link linux list load local login logo long main manager map master memory menu message method mobile mock model module monitor name native network node north number object option order page param parent parser password path pattern phone photo pixel placeholder platform player plugin point policy popup port post prefix private process product profile project property proxy public query random read record redacted release remote report request resource response result return root route sample schema score screen script search secret section select sequence server service session setting settings shape share simple site size socket source south space spring stack standard start state static status step storage stream string style submit support system table target task team template temp test testing text theme thread time title token tool tree trigger type update upload user util utils value vector version video view virtual visible web west widget width window word work world wrapper write your zone"
).split()
KEYED = "token|secret|passw|pwd|api[_-]?key|apikey|auth|bearer|credential|access[_-]?key|private[_-]?key|signature|sk_live|akia"
PREFIX = "AKIA|ASIA|gh[pousr]_|github_pat_|sk_live|sk-|xox[bap]-|AIza|eyJ|glpat-|npm_"
#: What is assigned to a telling name, at the end of the text: of any length, up to a space, quote or separator.
ASSIGNED = rf"(?i)(?:{KEYED})[A-Za-z0-9_.\-]*[\"'`\])]*\s*[=:]+>?\s*[\"'`]?(?:(?:bearer|basic)\b[\"'`]?\s*[=:]*>?\s*[\"'`]?)?+([^\s\"'`,;<>=:][^\s\"'`,;<>]*)(?=\S*$)"
FEATURES = ["length", "digits", "upper", "lower", "symbols", "distinct", "class_changes", "case_changes", "repeats", "vowel_pairs", "rare_pairs", "hex_only", "words", "assigned", "prefix", "separators", "neighbours", "path_words"]


@dataclass(frozen=True)
class Config:
    trees: int = 16
    depth: int = 5
    least_leaf: int = 4
    #: The forest learns from at most this many findings of each label, by hash of the finding.
    rows_per_label: int = 4_000
    least_probability: float = 0.5
    #: Words of the neighbourhood or path count if this many findings have them; this many that tell most are kept.
    least_findings: int = 5
    most_words: int = 300
    seed: int = 2


@dataclass
class Forest:
    trees: list = field(default_factory=list)
    #: Log-odds of words beside a candidate, and in its path.
    neighbours: dict[str, float] = field(default_factory=dict)
    path_words: dict[str, float] = field(default_factory=dict)


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """doc_id, position (word), candidate, before (three words), after (two words), path."""
    w = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.col(path).cast("string").alias("path"), F.split("text", r"[ \t\n\x0B\f\r]+").alias("w"))
    near = lambda *at: F.concat_ws(" ", *(F.get("w", F.col("position") + i) for i in at))
    each = w.select("doc_id", "path", "w", F.posexplode("w").alias("position", "word"))
    # letters beside a digit, in both cases, or with a known prefix: running text and plain numbers go early
    mixed = lambda c: c.rlike("[A-Za-z]") & (c.rlike("[0-9]") | (c.rlike("[a-z]") & c.rlike("[A-Z]")) | c.rlike(PREFIX))
    last = F.coalesce(F.get("w", F.col("position") - 1), F.lit(""))
    joined = reduce(lambda a, b: a | b, (F.col("word").contains(x) | last.contains(x) for x in "=:")) | F.lower(last).rlike("(bearer|basic)$")
    assigned = joined & F.concat_ws(" ", near(-3, -2, -1), "word").rlike(ASSIGNED)
    found = each.where(((F.length("word") >= 16) & mixed(F.col("word"))) | assigned).select(
        "doc_id", "path", F.col("position").cast("long").alias("position"), near(-3, -2, -1).alias("b"), near(1, 2).alias("after"), "word",
        F.filter(F.regexp_extract_all("word", F.lit(f"({CORE})"), 1), mixed).alias("core"),
    ).withColumn("value", F.regexp_extract(F.concat_ws(" ", "b", "word"), ASSIGNED, 1))
    # an assigned value is taken whole, in place of parts of it
    whole = F.when(F.col("value") == "", F.col("core")).otherwise(F.array_append(F.filter("core", lambda c: ~F.col("value").contains(c)), F.col("value")))
    return found.select("doc_id", "path", "position", F.explode(whole).alias("candidate"), "b", "after", "word").select(
        "doc_id", "path", "position", "candidate", F.concat_ws(" ", "b", F.expr("substring_index(word, candidate, 1)")).alias("before"), "after"
    )


def _log_odds(texts: list[str], labels: list[int], config: Config) -> dict[str, float]:
    """Log-odds of each word among the texts of label 1 and of label 0."""
    seen: dict[str, list[int]] = {}
    for text, label in zip(texts, labels, strict=True):
        for w in set(re.findall("[a-z]+", text.lower())):
            seen.setdefault(w, [0, 0])[label] += 1
    n = [labels.count(0) + 2, labels.count(1) + 2]
    told = {w: float(np.log((c[1] + 1) / n[1]) - np.log((c[0] + 1) / n[0])) for w, c in seen.items() if sum(c) >= config.least_findings}
    return dict(sorted(told.items(), key=lambda x: (-abs(x[1]), x[0]))[: config.most_words])


def _said(text: Column, odds: dict[str, float]) -> Column:
    """The sum of the log-odds of a text's distinct words."""
    if not odds:
        return F.lit(0.0)
    table = F.create_map(*(F.lit(x) for item in odds.items() for x in item))
    known = F.transform(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), 1)), lambda w: F.coalesce(F.try_element_at(table, w), F.lit(0.0)))
    return F.aggregate(known, F.lit(0.0), lambda a, b: a + b)


def features(found: DataFrame, forest: Forest = Forest()) -> DataFrame:
    """Add the columns of FEATURES to candidate, before, after and path."""
    c, low = F.col("candidate"), F.lower("candidate")
    n = F.length(c).cast("double")
    per = lambda pattern, of=c: F.regexp_count(of, F.lit(pattern)) / n
    known = "|".join(sorted((x for x in DICTIONARY if len(x) > 3), key=lambda x: (-len(x), x)))
    context, path = F.concat_ws(" ", "before", "after"), F.coalesce("path", F.lit(""))
    yes = lambda column, pattern: column.rlike(pattern).cast("double")
    columns = {
        "length": n,
        "digits": per("[0-9]"),
        "upper": per("[A-Z]"),
        "lower": per("[a-z]"),
        "symbols": per("[^A-Za-z0-9]"),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "class_changes": per("(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"),
        "case_changes": per("(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"),
        "repeats": per(r"(.)(?=\1)"),
        "vowel_pairs": per("(?<=[aeiou])(?=[bcdfghjklmnpqrstvwxyz])|(?<=[bcdfghjklmnpqrstvwxyz])(?=[aeiou])", low),
        "rare_pairs": per("(?=[bcdfghjklmnpqrstvwxz]{3})|[jqxz](?=[^aeiou])", low),
        "hex_only": yes(low, "^[0-9a-f]+$"),
        "words": 1 - F.length(F.regexp_replace(low, known, "")) / n,
        "assigned": yes(F.col("before"), r"[=:]\s*[\"'`]?\s*$"),
        "prefix": yes(c, f"^({PREFIX})"),
        "separators": per(r"[-_./]"),
        "neighbours": _said(context, forest.neighbours),
        "path_words": _said(path, forest.path_words),
    }
    # through a generator: else the optimizer would repeat each feature wherever a tree asks for it
    row = F.struct(*(F.coalesce(v.cast("double"), F.lit(0.0)).alias(k) for k, v in columns.items()))
    return found.withColumn("f", F.explode(F.array(row))).select(*found.columns, "f.*")


def labelled_findings(n: int = 3_000, seed: int = 2) -> list[tuple[str, str, str, str, int]]:
    """(candidate, before, after, path, label): findings made by rule, half of them real secrets.

    Real ones are random strings of the usual shapes, mostly assigned to a telling
    name. False ones are hashes, ids, placeholders, identifiers, paths and numbers.
    """
    r = random.Random(seed)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    filler = lambda k: " ".join(pick("aeiounrstlhd", r.randint(2, 9)) for _ in range(k))
    password = lambda k: "".join(r.sample(r.choice(letters[:26]) + r.choice(letters[26:52]) + r.choice("0123456789") + pick(letters + "-_!@#$%^&*", k - 3), k))
    word = lambda: r.choice(DICTIONARY)
    hexa = "0123456789abcdef"
    names = ["token", "secret", "password", "api_key", "apikey", "auth_token", "access_key", "private_key", "client_secret", "Authorization: Bearer", "credential"]
    paths = ["src/app.py", "config/prod.env", "deploy.yml", "src3", "web", "README.md", "main.go", "settings.json", "crawl/17"]
    test_paths = ["tests/test_auth.py", "docs/example.md", "fixtures/data.json", "package-lock.json", "spec/models.rb", "vendor/lib.min.js"]
    out = []
    for i in range(n):
        if i % 2 == 0:
            kind = r.randrange(10)
            value = [lambda: pick(hexa, r.choice([32, 40, 48, 64])), lambda: pick(letters, r.randint(20, 64)), lambda: "AKIA" + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), lambda: "ghp_" + pick(letters, 36), lambda: "sk_live_" + pick(letters, 24),
                     lambda: base64.b64encode(r.randbytes(r.randint(16, 40))).decode(), lambda: "eyJ" + pick(letters, 30) + "." + pick(letters, 40) + "." + pick(letters, 30),
                     lambda: password(r.randint(6, 15)), lambda: word() + pick("0123456789", r.randint(1, 3)) + r.choice("-_!@#$%") + pick(letters, r.randint(2, 6)), lambda: "eyJ" + pick(letters + "-_", r.randint(100, 500)) + "." + pick(letters + "-_", r.randint(100, 1000))][kind]()
            named = kind in (2, 3, 4, 6, 9) and r.random() < 0.3
            before = filler(3) + " " if named else f"{filler(r.randint(0, 2))} {r.choice(names)}{r.choice([' = ', '=', ': ', ':'])}"
            before += r.choice(['"', "'", "", '"'])
            after, path = filler(r.randint(0, 2)), r.choice(paths if r.random() < 0.9 else test_paths)
            if r.random() < 0.15:
                value, before = value.upper(), before.upper()
            out.append((value, before, after, path, 1))
        else:
            kind = r.randrange(13)
            value = [lambda: pick(hexa, r.choice([32, 40, 64])), lambda: str(uuid.UUID(int=r.getrandbits(128))), lambda: "_".join(["your", word(), word(), "key", str(r.randint(1, 9))]), lambda: word() + "".join(w.title() for w in (word(), word(), word())) + str(r.randint(0, 99)),
                     lambda: "/".join([word(), word(), word() + str(r.randint(1, 9)) + ".html"]), lambda: "x" * r.randint(12, 30) + str(r.randint(0, 9)) * r.randint(3, 8), lambda: pick("aeiounrstlhd", r.randint(6, 12)) + "." + str(r.randint(1, 99)) + "-mail" + str(r.randint(1, 9)) + ".example.com",
                     lambda: f"{r.randint(2000, 2026)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}-{r.randint(10, 59)}-00Z", lambda: pick("0123456789", r.randint(15, 18)) + r.choice(["px", "id", "ms"]),
                     lambda: r.choice([word(), pick("aeiounrstlhd", r.randint(1, 12)), word().title(), pick("0123456789", r.randint(1, 6)), r.choice("${%") + word() + "}", "".join(w.title() for w in (word(), word())), "None", "null", "true"]), lambda: word() + "".join(w.title() for w in (word(), word(), word())),
                     lambda: "/".join(r.choice([word(), word().title()]) for _ in range(r.randint(3, 8))), lambda: "/".join(pick("aeiounrstlhd", r.randint(3, 9)) for _ in range(r.randint(20, 90))) + str(r.randint(0, 9))][kind]()
            mark = r.choice(["commit ", "sha256: ", "md5 checksum ", "uuid=", "etag: ", "revision ", "digest ", "blob "]) if kind < 2 else r.choice([filler(1) + " ", "href=", "id: ", "token = ", "key: ", "see "]) if kind in (2, 3, 5) else filler(1) + " "
            if kind == 9:
                mark = r.choice(names + ["author", "signature", "secretary"]) + r.choice([" = ", "=", ": ", ":"])
            before, after = f"{filler(r.randint(0, 2))} {mark}" + r.choice(["", '"']), filler(r.randint(0, 2))
            out.append((value, before, after, r.choice(paths if r.random() < 0.6 else test_paths), 0))
    return out


FINDINGS = "candidate string, before string, after string, path string, label int"


def _grow(x: np.ndarray, y: np.ndarray, config: Config, rng: np.random.Generator, depth: int = 0):
    """A leaf (probability) or (feature, threshold, low, high), by Gini impurity over a random share of features."""
    p = float(y.mean())
    if depth == config.depth or len(y) < 2 * config.least_leaf or p in (0.0, 1.0):
        return p
    best = (1e-9, None, None)
    gini = p * (1 - p) * len(y)
    for f in rng.choice(x.shape[1], max(1, int(np.ceil(np.sqrt(x.shape[1])))), replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], np.cumsum(y[order])
        cuts = np.flatnonzero(v[1:] > v[:-1]) + 1
        cuts = cuts[(cuts >= config.least_leaf) & (cuts <= len(y) - config.least_leaf)]
        if not len(cuts):
            continue
        lo, hi = t[cuts - 1], t[-1] - t[cuts - 1]
        gain = gini - (lo * (1 - lo / cuts) + hi * (1 - hi / (len(y) - cuts)))
        j = int(gain.argmax())
        if gain[j] > best[0]:
            best = (float(gain[j]), int(f), float((v[cuts[j] - 1] + v[cuts[j]]) / 2))
    if best[1] is None:
        return p
    low = x[:, best[1]] <= best[2]
    return best[1], best[2], _grow(x[low], y[low], config, rng, depth + 1), _grow(x[~low], y[~low], config, rng, depth + 1)


def grow_forest(x: np.ndarray, y: np.ndarray, config: Config) -> list:
    rng, trees = np.random.default_rng(config.seed), []
    for _ in range(config.trees):
        rows = rng.integers(0, len(y), len(y))
        trees.append(_grow(x[rows], y[rows].astype(float), config, rng))
    return trees


def _tree(tree) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    f, t, low, high = tree
    return F.when(F.col(FEATURES[f]) <= t, _tree(low)).otherwise(_tree(high))


def forest_column(trees: list) -> Column:
    """Mean over the trees of the probability in the leaf that a row falls in."""
    return reduce(lambda a, b: a + b, map(_tree, trees)) / float(len(trees)) if trees else F.lit(0.0)


def fit(findings: DataFrame, config: Config = Config()) -> Forest:
    """A forest from labelled findings (candidate, before, after, path, label 0 or 1); without any, no trees."""
    known = findings.where(F.col("label").isin(0, 1) & F.col("candidate").isNotNull()).withColumn("half", F.pmod(F.xxhash64("candidate"), F.lit(2)))
    draw = F.xxhash64(F.lit(config.seed), "candidate", "before", "after")
    parts = [known.where(F.col("label") == v).orderBy(draw).limit(config.rows_per_label) for v in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    rows = chosen.select("half", "label", F.concat_ws(" ", "before", "after").alias("context"), F.coalesce("path", F.lit("")).alias("path")).collect()
    if not rows:
        return Forest()

    def odds(of) -> Forest:
        own = [r for r in rows if of(r["half"])]
        labels = [r["label"] for r in own]
        return Forest([], _log_odds([r["context"] for r in own], labels, config), _log_odds([r["path"] for r in own], labels, config))

    seen = [features(chosen.where(F.col("half") == h), odds(lambda x, h=h: x != h)) for h in (0, 1)]
    table = seen[0].unionByName(seen[1]).select("label", *FEATURES).collect()
    forest = odds(lambda h: True)
    forest.trees = grow_forest(np.array([[r[f] for f in FEATURES] for r in table], float), np.array([r["label"] for r in table]), config)
    return forest


def scan(docs: DataFrame, findings: DataFrame, config: Config = Config(), path: str = "source") -> DataFrame:
    """Secrets in documents: doc_id, position (of the word), secret, path, probability.

    Null and empty texts and null doc_ids have none. Repeated rows report each.
    A null path counts as empty. Other columns are ignored.
    """
    forest = fit(findings, config)
    # few rows are left here; dealt out anew, so that the forest's large expression has a stage of its own
    scored = features(candidates(docs, path).repartition("doc_id", "position"), forest).withColumn("probability", F.explode(F.array(forest_column(forest.trees))))
    return scored.where(F.col("probability") >= config.least_probability).select("doc_id", "position", F.col("candidate").alias("secret"), "path", "probability")


def findings_table(spark: SparkSession, n: int = 3_000) -> DataFrame:
    return spark.createDataFrame(labelled_findings(n), FINDINGS)
