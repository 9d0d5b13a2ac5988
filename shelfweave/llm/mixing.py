"""Mixing sources to target weights with soft membership.

A naive Bayes classifier is learned from the rows that carry a domain label and predicts
P(domain | text) for every document, labelled or not. A document of rate r then counts
r * tokens * P(d) towards domain d. The rates solve

    minimise  1/2 sum_d (total_d(r) - target_d)^2 / now_d    subject to  r_i >= min_rate

by projected gradient steps, where now_d is the total at rate one. In the metric that
weighs documents by tokens, the gradient for document i is sum_d P_i(d) error_d / now_d,
so a step needs only the D totals. They come from one aggregation over the documents; the
steps since rates were last stored are replayed from a row's posteriors, and nothing of the
size of the corpus reaches the driver.

Any number of domains works. The word tables have WORD_BUCKETS entries a domain; CHUNK of them
are held at a time, and with more domains a row keeps only the posteriors that count, with
the places of their domains. The driver holds a few numbers per domain. All work on rows is
DataFrame functions.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfweave.llm.text import packed, row_key, unpacked
from shelfweave.session import fresh_path, remove_path, store_table

WORD_BUCKETS = 4096
#: Domains whose word tables are held at once; up to so many, posteriors have an entry for every domain.
CHUNK = 64
#: With more, a posterior below exp(-SPAN) of the row's largest is taken as 0.
SPAN = 30.0
#: Labelled documents the classifier is learned from, about; drawn by a hash of id and text, as many from each domain
#: as from another where it has them, and LEAST from each at least.
SAMPLE, LEAST = 20_000, 50
#: Words whose evidence a long text counts with; keeps memberships soft.
EVIDENCE = 40
#: Steps end when no total moves by this share of all tokens, which takes some 30 where the targets can be met. Where they
#: cannot, totals creep, and MAX_STEPS ends within about two percent of the least loss.
MAX_STEPS, TOLERANCE = 60, 1e-5
#: Steps that are replayed before the rates are stored anew.
REPLAY = 6


def word_list(text: Column) -> Column:
    """Lower-case words between white space; none for NULL."""
    spaced = F.lower(F.coalesce(text, F.lit("")))
    for gap in ("\n", "\t", "\r"):
        spaced = F.replace(spaced, F.lit(gap), F.lit(" "))
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(WORD_BUCKETS)).cast("int")


def _unit(key: Column) -> Column:
    """A number in [0, 1) from a key."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 30)) / float(1 << 30)


def learn_domains(
    documents: DataFrame, domain: str, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE,
) -> tuple[list[str], list[float], DataFrame]:
    """Domains (sorted), log priors, and how often (n) words of bucket b stand in rows of domain d.

    Priors count all labelled rows.
    """
    labelled = documents.filter(F.col(domain).isNotNull())
    sizes = {r.d: r.n for r in labelled.groupBy(F.col(domain).cast("string").alias("d")).agg(F.count("*").alias("n")).collect()}
    domains = sorted(sizes)
    total = sum(sizes.values())
    shares = _drawn(sizes, sample)
    counts = (
        labelled.select(
            F.col(domain).cast("string").alias("d"), F.col(text).alias("text"),
            _unit(row_key(F.col(doc_id), F.col(text))).alias("at"))
        .join(_as_table(documents.sparkSession, shares), "d").filter(F.col("at") < F.col("share"))
        .select("d", F.explode(word_list(F.col("text"))).alias("w"))
        .groupBy("d", _bucket(F.col("w")).alias("b")).agg(F.count("*").alias("n")))
    if len(domains) > CHUNK:  # read once per chunk
        counts = store_table(counts, fresh_path(documents.sparkSession, "domain-words"))
    return domains, [math.log(sizes[d] / total) for d in domains], counts


def _drawn(sizes: dict[str, int], sample: int) -> dict[str, float]:
    """Share of each domain's rows to draw: equal numbers of rows, where small domains leave theirs to larger ones."""
    quota, left = float(sample), float(sample)
    for i, size in enumerate(sorted(sizes.values())):
        quota = left / (len(sizes) - i)
        if size > quota:
            break
        left -= size
        quota = float(max(size, left))
    return {d: min(1.0, max(quota, LEAST) / size) for d, size in sizes.items()}


def _as_table(spark: SparkSession, shares: dict[str, float]) -> DataFrame:
    """d and share; a few numbers per domain."""
    pairs = F.from_json(F.lit(json.dumps([{"d": d, "share": x} for d, x in shares.items()])), "array<struct<d:string,share:double>>")
    return spark.range(1).select(F.inline(pairs))


def _word_tables(counts: DataFrame, domains: list[str]) -> list[list[float]]:
    """log P(word bucket | domain) of up to CHUNK domains; flat for one without a word in the sample."""
    if not domains:
        return []
    found = {(r.d, r.b): r.n for r in counts.filter(F.col("d").isin(domains)).collect()}
    tables = []
    for d in domains:
        row = [found.get((d, b), 0) + 0.5 for b in range(WORD_BUCKETS)]
        norm = math.log(sum(row))
        tables.append([math.log(x) - norm for x in row])
    return tables


def _numbers(values: list[float], digits: int = 6) -> Column:
    """The values as one literal array (folded to a constant before the job runs)."""
    return F.split(F.lit(",".join(f"{v:.{digits}g}" for v in values)), ",").cast("array<double>")


def memberships(
    documents: DataFrame, model: tuple[list[str], list[float], DataFrame], doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """key, doc_id, n_tokens and p, the posteriors as an array, of every row. Without words they are the priors.

    With more than CHUNK domains p holds those that count, and ``at`` (after n_tokens) the places of their domains.
    """
    domains, priors, counts = model
    rows = documents.select(
        row_key(F.col(doc_id), F.col(text)).alias("key"), F.col(doc_id).alias("doc_id"),
        F.transform(word_list(F.col(text)), _bucket).alias("buckets"),
    ).select("key", "doc_id", F.size("buckets").cast("long").alias("n_tokens"), "buckets")
    if len(domains) > CHUNK:
        return _few_of_many(rows, domains, priors, counts)
    logs = _scored(rows, _word_tables(counts, domains), priors)
    names = [f"l_{j}" for j in range(len(domains))]
    top = F.greatest(*names) if len(names) > 1 else (F.col(names[0]) if names else F.lit(0.0))
    shares = logs.select("key", "doc_id", "n_tokens", *[F.exp(F.col(n) - top).alias(n) for n in names])
    total = sum((F.col(n) for n in names), F.lit(0.0))
    return shares.select("key", "doc_id", "n_tokens", F.array(*[F.col(n) / total for n in names]).cast("array<double>").alias("p"))


def _scored(rows: DataFrame, tables: list[list[float]], priors: list[float]) -> DataFrame:
    """``rows`` with l_0, l_1, ...: the log prior and the evidence for the domain of each table."""
    kept = rows.columns
    scored = rows.select(*kept, *[
        F.aggregate("buckets", F.lit(0.0), _added(_numbers(table))).alias(f"l_{j}") for j, table in enumerate(tables)])
    weight = F.least(F.lit(1.0), F.lit(float(EVIDENCE)) / F.greatest(F.col("n_tokens"), F.lit(1)))
    return scored.select(*kept, *[
        (F.lit(prior) + F.col(f"l_{j}") * weight).alias(f"l_{j}") for j, prior in enumerate(priors)])


def _few_of_many(rows: DataFrame, domains: list[str], priors: list[float], counts: DataFrame) -> DataFrame:
    """The memberships chunk by chunk; between chunks a row keeps the domains that are within SPAN of its best so far."""
    spark = rows.sparkSession
    found = rows.withColumn("best", F.array().cast("array<struct<at:int,l:double>>"))
    path = None
    for start in range(0, len(domains), CHUNK):
        chunk = slice(start, start + CHUNK)
        logs = _scored(found, _word_tables(counts, domains[chunk]), priors[chunk])
        new = F.array(*[
            F.struct(F.lit(start + j).alias("at"), F.col(f"l_{j}").alias("l")) for j in range(len(domains[chunk]))])
        both = logs.select(*rows.columns, F.concat("best", new).alias("best"))
        topped = both.select("*", F.array_max(F.transform("best", lambda x: x.l)).alias("top"))
        near = topped.select(*rows.columns, F.filter("best", lambda x: x.l >= F.col("top") - SPAN).alias("best"))
        before, path = path, fresh_path(spark, "chunk")
        found = store_table(near, path)
        if before:
            remove_path(spark, before)
    top = F.array_max(F.transform("best", lambda x: x.l))
    shares = found.select(
        "key", "doc_id", "n_tokens", F.transform("best", lambda x: x["at"]).alias("at"), "best", top.alias("top")).select(
        "key", "doc_id", "n_tokens", "at", F.transform("best", lambda x: F.exp(x.l - F.col("top"))).alias("p"))
    total = shares.select("*", F.aggregate("p", F.lit(0.0), lambda a, x: a + x).alias("total"))
    return total.select("key", "doc_id", "n_tokens", "at", F.transform("p", lambda x: x / F.col("total")).alias("p"))


def _added(table: Column):
    return lambda total, bucket: total + table[bucket]


def _stepped(rate: Column, last: Column, steps: list[tuple[float, list[float]]], min_rate: float, few: bool) -> Column:
    """The rate and the one before it (as a struct) after projected steps (momentum, pull on each domain)."""
    rows = F.array(*[_numbers([momentum, *pull], 17) for momentum, pull in steps])

    def step(state, row):
        ahead = state.rate + row[0] * (state.rate - state.last)
        pulls = F.transform("at", lambda j: row[j + 1]) if few else F.slice(row, 2, F.size("p"))
        along = F.aggregate(F.zip_with("p", pulls, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
        return F.struct(F.greatest(F.lit(min_rate), ahead - along).alias("rate"), state.rate.alias("last"))

    return F.aggregate(rows, F.struct(rate.alias("rate"), last.alias("last")), step)


def fit_rates(
    members: DataFrame, domains: list[str], targets: dict[str, float] | None = None, temper: float = 0.7,
    min_rate: float = 0.0, grow_only: bool = False,
) -> tuple[DataFrame, dict]:
    """``members`` with their ``rate``, and a report (totals now, targets, totals reached, steps).

    ``targets`` are weights of the domains (0 where missing). Without them the targets are the present shares to the
    power of ``temper``.
    The targets add up to the present tokens, or with ``grow_only`` to as many as no domain has to shrink.
    Where posteriors overlap and not all targets can be met, the result is the nearest in the weighted sense above.
    """
    n, min_rate = len(domains), float(min_rate)
    start = max(1.0, min_rate)
    members = members.withColumn("rate", F.lit(start))
    now = _totals(members, F.lit(1.0), n)
    total = sum(now)
    if not n or not total:
        return members, {"domains": domains, "now": now, "targets": now, "reached": now, "steps": 0}
    weights = [max(0.0, targets.get(d, 0.0)) for d in domains] if targets else [
        (x / total) ** temper if x > 0 else 0.0 for x in now]
    if not sum(weights):
        raise ValueError("no domain has a positive target")
    weights = [w / sum(weights) for w in weights]
    budget = max(x / w for x, w in zip(now, weights) if w) if grow_only else total
    wanted = [budget * w for w in weights]

    scale = [max(x, total * 1e-9) for x in now]
    # the largest eigenvalue of the totals' response: a row's posteriors add up to one, so that of now^-1 P'WP is one
    eta = 1.0 / (1 + 1e-6)

    state = members.select("*", F.col("rate").alias("last"))
    reached = before = [x * start for x in now]
    pending, steps, pace = [], 0, 1.0
    for steps in range(1, MAX_STEPS + 1):
        if len(pending) == REPLAY:
            state = store_table(_replayed(state, pending, min_rate), fresh_path(state.sparkSession, "rates"))
            pending = []
        # accelerated steps (Beck, Teboulle 2009); totals are linear in the rates, also in those ahead
        faster = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        momentum, pace = (pace - 1) / faster, faster
        ahead = [r + momentum * (r - b) for r, b in zip(reached, before)]
        pending.append((momentum, [eta * (a - t) / s for a, t, s in zip(ahead, wanted, scale)]))
        before, reached = reached, _totals(_replayed(state, pending, min_rate), F.col("rate"), n)
        if max(abs(a - b) for a, b in zip(before, reached)) <= TOLERANCE * total:
            break
    report = {"domains": domains, "now": now, "targets": wanted, "reached": reached, "steps": steps}
    return _replayed(state, pending, min_rate).drop("last"), report


def _totals(members: DataFrame, rate: Column, n: int) -> list[float]:
    """Tokens times rate of all rows, per domain."""
    weight = F.col("n_tokens") * rate
    if "at" not in members.columns:
        sums = members.agg(F.count("*"), *[F.coalesce(F.sum(weight * F.col("p")[j]), F.lit(0.0)) for j in range(n)]).first()
        return list(sums[1:])
    parts = members.select(weight.alias("w"), F.explode(F.arrays_zip("at", "p")).alias("x"))
    sums = {r.j: r.s for r in parts.groupBy(F.col("x.at").alias("j")).agg(F.sum(F.col("w") * F.col("x.p")).alias("s")).collect()}
    return [sums.get(j, 0.0) for j in range(n)]


def _replayed(state: DataFrame, pending: list[tuple[float, list[float]]], min_rate: float) -> DataFrame:
    few = "at" in state.columns
    kept = ["key", "doc_id", "n_tokens", *(["at"] if few else []), "p"]
    moved = _stepped(F.col("rate"), F.col("last"), pending, min_rate, few)
    return state.select(*kept, moved.alias("x")).select(*kept, "x.rate", "x.last")


def mix(
    documents: DataFrame, domain: str, targets: dict[str, float] | None = None, doc_id: str = "doc_id",
    text: str = "text", sample: int = SAMPLE, **options,
) -> tuple[DataFrame, dict]:
    """key, doc_id, n_tokens, domain (the likeliest), rate, copies of every row, and the report of ``fit_rates``.

    ``copies`` is the rate rounded up or down at random by a hash, so that its expectation is the rate. Rows without
    a domain are not learned from but get posteriors and a rate. Without any label, or any word, all rates are 1.
    Repeated rows all stay, with equal rates; an empty table gives no rows; other columns are ignored.
    """
    spark = documents.sparkSession
    model = learn_domains(documents, domain, doc_id, text, sample)
    domains = model[0]
    members = store_table(memberships(documents, model, doc_id, text), fresh_path(spark, "memberships"))
    rated, report = fit_rates(members, domains, targets, **options)
    likeliest = F.lit(None).cast("string")
    if domains:
        place = F.array_position("p", F.array_max("p")).cast("int") - 1
        likeliest = F.array(*[F.lit(d) for d in domains])[F.col("at")[place] if "at" in members.columns else place]
    rated = rated.select("key", "doc_id", "n_tokens", likeliest.alias("domain"), F.round("rate", 6).alias("rate"))
    copies = F.floor(F.col("rate") + _unit(F.concat(F.lit("copies"), F.col("key")))).cast("long")
    return rated.withColumn("copies", copies), report


def resample(documents: DataFrame, domain: str, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``documents`` with every row repeated ``copies`` times (not at all for 0); all columns stay as they are."""
    rated, _ = mix(documents, domain, doc_id=doc_id, text=text, **options)
    # rows with equal key have equal copies; most rows appear once and need no entry
    moved = rated.filter("copies <> 1").groupBy("key").agg(F.max("copies").alias("copies"))
    keyed = packed(documents, key=row_key(F.col(doc_id), F.col(text))).join(moved, "key", "left")
    times = F.coalesce(F.col("copies"), F.lit(1).cast("long"))
    repeated = keyed.filter(times > 0).select("row", F.explode(F.sequence(F.lit(1).cast("long"), times)).alias("copy"))
    return unpacked(repeated)
