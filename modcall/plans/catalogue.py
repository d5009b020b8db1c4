"""Queries over the driver's tables, by name, and the DuckDB SQL that gives the same rows."""

from pyspark.sql import functions as F

from ..functions import sequence, signal
from ..operators import diff, events, features, metrics, modtags, sites, training
from ..operators.ranking import running
from ..streaming import chunks
from .adapters import EV, KM, PAIRS, RC, UC, kmer_model, pairs, read_calls, site_preds, sp_sql, table, unique_calls
from .adapters import events as event_rows

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
SITE = sites.SITE


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- sites -----------------------------------------------------------------------------------------------

SITES = f"""{RC}, st AS (SELECT contig, pos, ninemer, count(*) AS coverage, count(*) FILTER (WHERE prob > 0.5) AS n_mod,
  count(*) FILTER (WHERE prob < 0.5) AS n_unmod FROM rc GROUP BY ALL HAVING count(*) >= 20 AND n_mod + n_unmod > 0)"""


@query(f"WITH {SITES} SELECT *, n_mod / (n_mod + n_unmod) AS stoichiometry FROM st")
def site_coverage_stoich(spark, sf_dir):
    return sites.coverage_stoichiometry(read_calls(spark, sf_dir))


@query(f"WITH {RC} SELECT contig, pos, ninemer, least(CAST(floor(prob * 100) AS INT), 99) AS bin, count(*) AS n FROM rc GROUP BY ALL")
def site_histogram100(spark, sf_dir):
    return sites.histogram(read_calls(spark, sf_dir), SITE, sites.bin100(F.col("prob")))


@query(f"""WITH {RC}, h AS (SELECT pos, least(CAST(floor(prob * 100) AS INT), 99) AS bin, count(*) AS n FROM rc GROUP BY ALL)
SELECT p.pos, string_agg(CAST(coalesce(n, 0) AS VARCHAR), ',' ORDER BY b.bin) AS histogram
FROM (SELECT DISTINCT pos FROM rc) p CROSS JOIN (SELECT CAST(range AS INT) AS bin FROM range(100)) b LEFT JOIN h ON h.pos = p.pos AND h.bin = b.bin GROUP BY p.pos""")
def site_histogram_dense(spark, sf_dir):
    tall = sites.histogram(read_calls(spark, sf_dir), ["pos"], sites.bin100(F.col("prob")))
    return sites.dense(tall, ["pos"]).select("pos", F.array_join(F.col("histogram").cast("array<string>"), ",").alias("histogram"))


@query(f"WITH {RC} SELECT pos, least(CAST(floor(prob * 100) AS INT), 99) - 1 AS bin, count(*) AS n FROM rc WHERE prob >= CAST(0.01 AS DOUBLE) GROUP BY ALL")
def site_hist_legacy99(spark, sf_dir):
    return sites.histogram(read_calls(spark, sf_dir), ["pos"], sites.bin99(F.col("prob")))


@query(f"""WITH {RC} SELECT pos, CASE WHEN prob < 0.1 THEN 0 WHEN prob < 0.25 THEN 1 WHEN prob < 0.5 THEN 2 WHEN prob < 0.9 THEN 3 ELSE 4 END AS bin, count(*) AS n
FROM rc GROUP BY ALL""")
def site_hist_percentile(spark, sf_dir):
    return sites.histogram(read_calls(spark, sf_dir), ["pos"], sites.bin_edges(F.col("prob"), [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]))


@query(f"""WITH {RC} SELECT pos, least(CAST(floor(prob * 100) AS INT), 99) AS bin, count(*) AS n,
count(*) FILTER (WHERE base <> substr(ninemer, 5, 1)) AS n_mismatch FROM rc GROUP BY ALL""")
def site_hist_mismatch(spark, sf_dir):
    return sites.histogram(read_calls(spark, sf_dir), ["pos"], sites.bin100(F.col("prob")), n_mismatch=F.col("base") != F.substring("ninemer", 5, 1))


@query(f"""WITH {RC} SELECT contig, pos, ninemer, count(*) FILTER (WHERE base = 'A') AS n_a, count(*) FILTER (WHERE base = 'C') AS n_c,
count(*) FILTER (WHERE base = 'G') AS n_g, count(*) FILTER (WHERE base = 'T') AS n_t, count(*) FILTER (WHERE base NOT IN ('A', 'C', 'G', 'T')) AS n_other FROM rc GROUP BY ALL""")
def site_base_composition(spark, sf_dir):
    return sites.base_composition(read_calls(spark, sf_dir))


@query(f"""WITH {RC}, h AS (SELECT pos, sum(least(CAST(floor(prob * 100) AS INT), 99)) AS bins, count(*) AS n FROM rc GROUP BY pos)
SELECT pos, round(bins / (99 * n), 9) AS probability FROM h""")
def site_score_linear(spark, sf_dir):
    tall = sites.histogram(read_calls(spark, sf_dir), ["pos"], sites.bin100(F.col("prob")))
    scored = sites.score(sites.dense(tall, ["pos"]), "histogram", "x", sites.linear_scorer)
    return scored.select("pos", F.round(1 - F.col("x"), 9).alias("probability"))


def _order():
    return [F.col(c).cast("string") for c in ("read_id", "read_pos", "l_partkey", "l_suppkey")]



@query(f"""WITH {RC}, st AS (SELECT l_suppkey, count(*) AS coverage, count(*) FILTER (WHERE prob > 0.5) AS n_mod, count(*) FILTER (WHERE prob < 0.5) AS n_unmod
  FROM rc GROUP BY ALL HAVING count(*) >= 20 AND n_mod + n_unmod > 0),
routed AS (SELECT *, n_mod / (n_mod + n_unmod) AS stoichiometry, coverage > 150 AND n_mod / (n_mod + n_unmod) > 0.1 AS deep FROM st),
many AS (SELECT rc.*, draw, row_number() OVER (PARTITION BY rc.l_suppkey, draw ORDER BY md5(concat_ws(':', draw, read_id, read_pos, l_partkey, rc.l_suppkey)),
    CAST(read_id AS VARCHAR), CAST(read_pos AS VARCHAR), CAST(l_partkey AS VARCHAR)) AS rank
  FROM rc JOIN routed USING (l_suppkey) CROSS JOIN (SELECT range AS draw FROM range(21)) WHERE deep),
reads AS (SELECT l_suppkey, draw, prob FROM many WHERE rank <= 100 UNION ALL SELECT l_suppkey, 0, prob FROM rc JOIN routed USING (l_suppkey) WHERE NOT deep),
scored AS (SELECT l_suppkey, draw, avg(least(floor(prob * 100), 99)) / 99 AS p FROM reads GROUP BY ALL)
SELECT l_suppkey, coverage, n_mod, n_unmod, round(stoichiometry, 9) AS stoichiometry, round(avg(p), 9) AS probability FROM scored JOIN routed USING (l_suppkey) GROUP BY ALL""")
def site_bootstrap_mean(spark, sf_dir):
    got = sites.site_probabilities(read_calls(spark, sf_dir), ["l_suppkey"], _order())
    return got.withColumns({"stoichiometry": F.round("stoichiometry", 9), "probability": F.round("probability", 9)})


# --- differential ----------------------------------------------------------------------------------------

CONDITIONS2, CONDITIONS3 = ["A", "R"], ["A", "N", "R"]


@query(f"""WITH {sp_sql()} SELECT contig, position, site, condition, string_agg(rep, ',' ORDER BY rep) AS reps, string_agg(CAST(coverage AS VARCHAR), ',' ORDER BY rep) AS coverage,
string_agg(CAST(CAST(round(coalesce(stoichiometry, 0) * 1000000) AS BIGINT) AS VARCHAR), ',' ORDER BY rep) AS stoichiometry FROM sp GROUP BY ALL""")
def diff_pivot(spark, sf_dir):
    return pivot_columns(diff.pivot_replicates(site_preds(spark, sf_dir)))


def pivot_columns(got):
    ppm = F.transform("stoichiometry", lambda s: F.round(F.coalesce(s, F.lit(0.0)) * 1000000).cast("long").cast("string"))
    return got.select(*diff.KEYS, "condition", F.array_join("rep", ",").alias("reps"), F.array_join(F.col("coverage").cast("array<string>"), ",").alias("coverage"), F.array_join(ppm, ",").alias("stoichiometry"))


def _tests(conditions: list[str], by_line: bool = False, more: str = "") -> str:
    k, listed = len(conditions), ", ".join(f"'{c}'" for c in conditions)

    def ll(s, n):
        return f"(CASE WHEN {s} > 0 THEN {s} * ln({s} / {n}) ELSE 0 END + CASE WHEN {n} - {s} > 0 THEN ({n} - {s}) * ln(({n} - {s}) / {n}) ELSE 0 END)"

    avgs = ", ".join(f"max(average) FILTER (WHERE condition = '{c}') AS a{i}" for i, c in enumerate(conditions))
    names = [f"a{i}" for i in range(k)]
    return f"""{sp_sql(by_line)}, tot AS (SELECT contig, position, site, condition, sum(coverage * coalesce(stoichiometry, 0)) AS weighted, CAST(sum(coverage) AS DOUBLE) AS reads,
  sum(round_even(coverage * coalesce(stoichiometry, 0), 0)) AS hits, count(*) FILTER (WHERE coverage > 0) AS rows,
  coalesce(max(probability) > 0, false) AND coalesce(max(stoichiometry) > 0, false) AS passes, weighted / reads AS average
  FROM sp WHERE condition IN ({listed}) GROUP BY ALL),
per AS (SELECT contig, position, site, count(*) FILTER (WHERE passes) AS n_pass, bool_and(rows = 1) AND count(*) = {k} AS single, sum(rows) AS n_rows,
  sum({ll("weighted", "reads")}) AS w, sum(weighted) AS ws, sum(reads) AS n, sum({ll("hits", "reads")}) AS h, sum(hits) AS hs, {avgs} FROM tot GROUP BY ALL HAVING n_pass >= {k}),
tests AS (SELECT contig, position, site, {", ".join(names)}, greatest({", ".join(names)}) - least({", ".join(names)}) AS delta, CASE WHEN single THEN 'chi2' ELSE 'F' END AS test,
  greatest(0, CASE WHEN single THEN 2 * (w - {ll("ws", "n")}) ELSE 2 * (h - {ll("hs", "n")}) END) AS deviance, CAST(n_rows - {k - 1} AS INT) AS df2 FROM per){more}"""


@query(f"WITH {_tests(CONDITIONS2)} SELECT contig, position, site, round(a0, 6) AS avg_a, round(a1, 6) AS avg_r, round(delta, 6) AS delta FROM tests")
def diff_filtered(spark, sf_dir):
    got = diff.site_tests(site_preds(spark, sf_dir), CONDITIONS2)
    return got.select(*diff.KEYS, F.round("avg_stoichi_A", 6).alias("avg_a"), F.round("avg_stoichi_R", 6).alias("avg_r"), F.round("delta", 6).alias("delta"))


@query(f"WITH {_tests(CONDITIONS2, True)} SELECT contig, position, site, test, df2, round(deviance, 6) AS deviance FROM tests")
def diff_deviance(spark, sf_dir):
    got = diff.site_tests(site_preds(spark, sf_dir, True), CONDITIONS2)
    return got.select(*diff.KEYS, "test", "df2", F.round("deviance", 6).alias("deviance"))


_T = "atan(sqrt(deviance / df2))"
_F2 = f"""CASE df2 WHEN 1 THEN 1 - 2 * {_T} / pi() WHEN 2 THEN 1 - sin({_T}) WHEN 3 THEN 1 - (2 / pi()) * ({_T} + sin({_T}) * cos({_T})) END"""


@query(f"WITH {_tests(CONDITIONS2)} SELECT contig, position, site, df2, round(greatest(0, {_F2}), 6) AS pval FROM tests WHERE test = 'F' AND df2 > 0")
def diff_f_pvalue_2cond(spark, sf_dir):
    got = diff.site_tests(site_preds(spark, sf_dir), CONDITIONS2).where("test = 'F' and df2 > 0")
    return got.select(*diff.KEYS, "df2", F.round(diff.p_value(2), 6).alias("pval"))


@query(f"WITH {_tests(CONDITIONS3, True)} SELECT contig, position, site, test, df2, round(CASE WHEN test = 'chi2' THEN exp(-deviance / 2) WHEN df2 > 0 THEN pow(1 + deviance / df2, -df2 / 2) END, 6) AS pval FROM tests")
def diff_chi2_3cond(spark, sf_dir):
    got = diff.site_tests(site_preds(spark, sf_dir, True), CONDITIONS3)
    return got.select(*diff.KEYS, "test", "df2", F.round(diff.p_value(3), 6).alias("pval"))


@query(f"""WITH {_tests(CONDITIONS2, more=f", p AS (SELECT *, greatest(0, {_F2}) AS pval FROM tests)")},
fit AS (SELECT *, row_number() OVER (ORDER BY pval, contig, position, site) AS rank, count(*) OVER () AS m FROM p WHERE delta >= 0.05 AND pval IS NOT NULL),
adj AS (SELECT *, least(1, min(pval * m / rank) OVER (ORDER BY rank DESC)) AS adj_pval FROM fit)
SELECT contig, position, site, round(pval, 6) AS pval, round(adj_pval, 6) AS adj_pval FROM adj
UNION ALL SELECT contig, position, site, round(pval, 6), 1 FROM p WHERE NOT coalesce(delta >= 0.05 AND pval IS NOT NULL, false)""")
def diff_bh(spark, sf_dir):
    got = diff.differential(site_preds(spark, sf_dir), CONDITIONS2, min_delta=0.05)
    return got.select(*diff.KEYS, F.round("pval", 6).alias("pval"), F.round("adj_pval", 6).alias("adj_pval"))


# --- events ----------------------------------------------------------------------------------------------


@query(f"""WITH {EV}, i AS (SELECT *, pos - row_number() OVER (PARTITION BY read_id ORDER BY pos) AS island FROM ev)
SELECT read_id, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n FROM i GROUP BY read_id, island""")
def event_islands(spark, sf_dir):
    got = events.islands(event_rows(spark, sf_dir), ["read_id"])
    return got.groupBy("read_id", "island").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count("*").alias("n")).drop("island")


NINE = f"""{EV}, i AS (SELECT *, pos - row_number() OVER (PARTITION BY read_id ORDER BY pos) AS island FROM ev),
nine AS (SELECT read_id, pos - 4 AS start, first_value(kmer) OVER w || string_agg(substr(kmer, 5, 1), '') OVER w4 AS ninemer, count(*) OVER w AS n, sum(value) OVER w AS total
  FROM i WINDOW w AS (PARTITION BY read_id, island ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
  w4 AS (PARTITION BY read_id, island ORDER BY pos ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) QUALIFY n = 5)"""


def _nine(spark, sf_dir, centre=None):
    return events.ninemers(event_rows(spark, sf_dir), ["read_id"], centre)


@query(f"WITH {NINE} SELECT read_id, start, ninemer, round(total, 6) AS total FROM nine")
def ninemer_windows(spark, sf_dir):
    first = F.aggregate("five", F.lit(0.0), lambda a, e: a + e["samples"][0])
    return _nine(spark, sf_dir).select("read_id", "start", "ninemer", F.round(first, 6).alias("total"))


@query(f"WITH {NINE} SELECT read_id, start, ninemer FROM nine WHERE substr(ninemer, 5, 1) = 'A'")
def rolling_seq(spark, sf_dir):
    return _nine(spark, sf_dir, "A").select("read_id", "start", "ninemer")


@query("""WITH e AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)) // 3 AS pos FROM events)
SELECT user_id AS read_id, pos, min(event_id) AS line_no, string_agg(CAST(CAST(round(value * 100) AS BIGINT) + 100 AS VARCHAR) || ',' || CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY event_id) AS samples
FROM e GROUP BY ALL""")
def event_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("user_id AS read_id", "event_id AS line_no", "(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)) div 3 AS pos", "array(cast(round(value * 100) AS bigint), cast(round(value * 100) AS bigint) + 100) AS samples")
    return events.merge_events(rows, ["read_id"]).withColumn("samples", F.array_join(F.col("samples").cast("array<string>"), ","))


@query(f"WITH {NINE} SELECT ninemer, read_id, start, row_number() OVER (PARTITION BY ninemer ORDER BY read_id, start) AS rank FROM nine QUALIFY rank <= 20")
def trim_first_n(spark, sf_dir):
    return events.take(_nine(spark, sf_dir), ["ninemer"], ["read_id", "start"], 20).select("ninemer", "read_id", "start", "rank")


@query(f"WITH {NINE} SELECT ninemer, read_id, start, row_number() OVER (PARTITION BY ninemer ORDER BY read_id, start) AS rank FROM nine QUALIFY rank > 5 AND rank <= 15")
def trim_skip_take(spark, sf_dir):
    return events.take(_nine(spark, sf_dir), ["ninemer"], ["read_id", "start"], 15, 5).select("ninemer", "read_id", "start", "rank")


@query(f"""WITH {RC}, q AS (SELECT translate(to_base(p_partkey % 262144, 4, 9), '0123', 'ACGT') AS ninemer, max_by(p_size % 7, p_partkey) AS max_n FROM part GROUP BY 1)
SELECT ninemer, read_id, read_pos, l_suppkey, row_number() OVER (PARTITION BY ninemer ORDER BY read_id, read_pos, l_suppkey) AS rank, max_n FROM rc JOIN q USING (ninemer) QUALIFY rank <= max_n""")
def quota_per_kmer(spark, sf_dir):
    listed = table(spark, sf_dir, "part").selectExpr("translate(lpad(conv(p_partkey % 262144, 10, 4), 9, '0'), '0123', 'ACGT') AS ninemer", "p_size % 7 AS max_n", "p_partkey AS line_no")
    return events.within_quota(read_calls(spark, sf_dir), listed, ["read_id", "read_pos", "l_suppkey"]).select("ninemer", "read_id", "read_pos", "l_suppkey", "rank", "max_n")


@query("SELECT o_orderkey, CAST(least((row_number() OVER (ORDER BY o_orderkey) - 1) // ((count(*) OVER ()) // 7), 6) AS INT) AS shard FROM orders")
def shard_contiguous(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    ranked = running(orders, "o_orderkey", {"rank": F.lit(1)})
    return ranked.crossJoin(F.broadcast(orders.agg(F.count("*").alias("n")))).select("o_orderkey", events.shard(F.col("rank"), F.col("n"), 7).alias("shard"))


# --- signals, qualities and features -----------------------------------------------------------------------


def _signals(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))


_SUMS = "round(list_sum(y), 6) AS total, round(y[1], 6) AS first_value, round(y[28], 6) AS inner_value, round(y[36], 6) AS last_value"


def _sums(df):
    return df.select("vec_id", F.round(F.aggregate("y", F.lit(0.0), lambda a, v: a + v), 6).alias("total"), *[F.round(F.element_at("y", i), 6).alias(n) for i, n in ((1, "first_value"), (28, "inner_value"), (36, "last_value"))])


@query(f"""WITH s AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
r AS (SELECT vec_id, list_transform(range(36), lambda i: list_avg(x[CAST(i + least(i, 28) + 1 AS INT) : CAST(i + least(i, 28) + CASE WHEN i < 28 THEN 2 ELSE 1 END AS INT)])) AS y FROM s)
SELECT vec_id, {_SUMS} FROM r""")
def signal_compress36(spark, sf_dir):
    return _sums(_signals(spark, sf_dir).withColumn("y", signal.compress(F.col("x"))))


@query(f"""WITH s AS (SELECT vec_id, CAST(embedding[1:20] AS DOUBLE[]) AS x FROM embeddings),
r AS (SELECT vec_id, list_append(flatten(list_transform(range(19), lambda g: list_transform(range(CASE WHEN g < 16 THEN 2 ELSE 1 END), lambda j:
  x[CAST(g + 1 AS INT)] + j * (x[CAST(g + 2 AS INT)] - x[CAST(g + 1 AS INT)]) / CASE WHEN g < 16 THEN 2 ELSE 1 END))), x[20]) AS y FROM s)
SELECT vec_id, {_SUMS} FROM r""")
def signal_interp36(spark, sf_dir):
    return _sums(_signals(spark, sf_dir).withColumn("y", signal.interpolate(F.slice("x", 1, 20))))


@query("SELECT vec_id, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda v: (v - CAST(0.25 AS DOUBLE)) / CAST(1.5 AS DOUBLE))), 6) AS total FROM embeddings")
def signal_scale(spark, sf_dir):
    scaled = signal.rescale(F.col("x"), F.lit(0.25), F.lit(1.5))
    return _signals(spark, sf_dir).select("vec_id", F.round(F.aggregate(scaled, F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda v: (CAST(floor(CAST(v AS DOUBLE) * 1000) AS INT) + 10) * (CAST(1400 AS DOUBLE) / 8192))), 6) AS total FROM embeddings")
def raw_to_pa(spark, sf_dir):
    raw = F.transform("x", lambda v: F.floor(v * 1000).cast("int"))
    pa = signal.to_picoampere(raw, F.lit(10.0), F.lit(1400.0), F.lit(8192.0))
    return _signals(spark, sf_dir).select("vec_id", F.round(F.aggregate(pa, F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


_Q = "CAST((read_id + l_suppkey) % 41 AS INT)"
_PHRED = "CASE WHEN q = 0 THEN 0 WHEN base = substr(ninemer, 5, 1) THEN q ELSE -10 * log10(1 - pow(CAST(10 AS DOUBLE), -q / CAST(10 AS DOUBLE))) END"


@query(f"WITH {RC}, b AS (SELECT *, {_Q} AS q FROM rc) SELECT read_id, read_pos, l_partkey, l_suppkey, q, round({_PHRED}, 6) AS adjusted FROM b")
def phred_adjust(spark, sf_dir):
    rows = read_calls(spark, sf_dir).withColumn("q", F.expr("cast((read_id + l_suppkey) % 41 as int)"))
    return rows.select("read_id", "read_pos", "l_partkey", "l_suppkey", "q", F.round(signal.phred_adjust(F.col("q"), F.col("base"), F.substring("ninemer", 5, 1)), 6).alias("adjusted"))


@query("""WITH q AS (SELECT vec_id, list_transform(embedding[1:9], lambda v: greatest(0, floor(CAST(v AS DOUBLE) * 100))) AS q FROM embeddings),
m AS (SELECT vec_id, q, list_avg(list_filter(q, lambda v: v <> 0)) AS mean FROM q)
SELECT vec_id, round(list_sum(list_transform(q, lambda v: CASE WHEN v = 0 THEN mean ELSE v END)), 6) AS total FROM m""")
def quality_fill(spark, sf_dir):
    q = F.transform(F.slice("x", 1, 9), lambda v: F.greatest(F.lit(0.0), F.floor(v * 100).cast("double")))
    return _signals(spark, sf_dir).withColumn("q", q).select("vec_id", F.round(F.aggregate(signal.fill_zeros(F.col("q")), F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@query(f"""WITH {RC}, {KM}, k AS (SELECT DISTINCT ninemer FROM rc), c AS (SELECT ninemer, i, b, substr(ninemer[1:4] || b || ninemer[6:9], CAST(i AS INT), 5) AS kmer
  FROM k CROSS JOIN (SELECT range AS i FROM range(1, 6)) CROSS JOIN (SELECT unnest(['A', 'C', 'G', 'T']) AS b))
SELECT ninemer, count(mean) AS known, round(coalesce(sum(mean), 0), 3) AS total FROM c LEFT JOIN km USING (kmer) GROUP BY ninemer""")
def kmer_distance(spark, sf_dir):
    nine = read_calls(spark, sf_dir).select("ninemer").distinct()
    flat = features.expected(nine, kmer_model(spark, sf_dir)).select("ninemer", F.filter(F.flatten("expected"), lambda m: m.isNotNull()).alias("m"))
    return flat.select("ninemer", F.size("m").cast("long").alias("known"), F.round(F.aggregate("m", F.lit(0.0), lambda a, v: a + v), 3).alias("total"))


@query(f"WITH {RC} SELECT DISTINCT ninemer, ninemer[1:4] || b || ninemer[6:9] AS changed FROM rc CROSS JOIN (SELECT unnest(['A', 'C', 'G', 'T']) AS b)")
def center_substitute(spark, sf_dir):
    return read_calls(spark, sf_dir).select("ninemer").distinct().select("ninemer", F.explode(sequence.substitutions(F.col("ninemer"))).alias("changed"))


@query(f"WITH {RC} SELECT DISTINCT ninemer, CAST(length(ninemer) - length(replace(ninemer, 'A', '')) AS INT) AS n_a FROM rc WHERE length(ninemer) - length(replace(ninemer, substr(ninemer, 5, 1), '')) = 1")
def kmer_center_unique(spark, sf_dir):
    nine = read_calls(spark, sf_dir).select("ninemer").distinct()
    return nine.where(F.regexp_count("ninemer", F.substring("ninemer", 5, 1)) == 1).select("ninemer", F.regexp_count("ninemer", F.lit("A")).alias("n_a"))


@query(f"""WITH {RC} SELECT base, CASE base WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 ELSE 4 END AS base_index, count(*) AS n FROM rc GROUP BY ALL""")
def base_indexes(spark, sf_dir):
    return read_calls(spark, sf_dir).groupBy("base", sequence.base_index(F.col("base")).alias("base_index")).agg(F.count("*").alias("n"))


@query(f"""WITH {NINE}, {KM}, f AS (SELECT i.read_id, nine.start, nine.ninemer, i.pos - nine.start AS o, i.value FROM nine JOIN i ON i.read_id = nine.read_id AND i.pos BETWEEN nine.start AND nine.start + 4
  WHERE substr(nine.ninemer, 5, 1) = 'C'),
d AS (SELECT f.*, b, mean FROM f CROSS JOIN (SELECT unnest(['A', 'C', 'G', 'T']) AS b) LEFT JOIN km ON km.kmer = substr(ninemer[1:4] || b || ninemer[6:9], CAST(o + 1 AS INT), 5))
SELECT read_id, start, ninemer, CAST(180 AS BIGINT) AS n_rows, round(sum(36 * value + CAST(35.5 AS DOUBLE)) FILTER (WHERE b = 'A'), 3) AS current_sum, round(coalesce(sum(36 * mean - 36 * value - CAST(35.5 AS DOUBLE)), 0), 3) AS distance_sum,
CAST(180 * 3 AS DOUBLE) AS dwell_sum, CAST(20 * 45 AS DOUBLE) AS quality_sum FROM d GROUP BY read_id, start, ninemer""")
def feature_tensor_checksum(spark, sf_dir):
    wide = features.expected(_nine(spark, sf_dir, "C"), kmer_model(spark, sf_dir)).withColumn("quality", F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: i.cast("double")))
    made = features.tensor(wide)

    def total(*cols):
        return F.aggregate("features", F.lit(0.0), lambda a, r: a + sum((F.coalesce(F.get(r, F.lit(c)), F.lit(0.0)) for c in cols[1:]), F.coalesce(F.get(r, F.lit(cols[0])), F.lit(0.0))))

    return made.select("read_id", "start", "ninemer", F.size("features").cast("long").alias("n_rows"), F.round(total(0), 3).alias("current_sum"), F.round(total(1, 2, 3, 4), 3).alias("distance_sum"), F.round(total(5), 3).alias("dwell_sum"), F.round(total(6), 3).alias("quality_sum"))


_RUNS = """runs AS (SELECT l_orderkey AS read_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, concat(CAST(l_quantity AS INT) % 10 + 1, {op})) AS i,
  CAST(l_quantity AS INT) % 10 + 1 AS len, {op} AS op FROM lineitem)"""
_CIGAR, _MOVES = "substr('MIDNS', CAST(l_linenumber % 5 AS INT) + 1, 1)", "substr(',,ID', CAST(l_linenumber % 4 AS INT) + 1, 1)"


def _runs(spark, sf_dir, op):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS read_id", "l_linenumber", "l_partkey", "l_suppkey", f"concat(cast(l_quantity AS int) % 10 + 1, {op}) AS run")
    return rows.groupBy("read_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "run"))), lambda r: r["run"]), "").alias("text"))


@query(f"""WITH {_RUNS.format(op=_CIGAR)} SELECT read_id, CAST(i - 1 AS INT) AS run, op, len,
CAST(coalesce(sum(CASE WHEN op IN ('M', 'D', 'N') THEN len ELSE 0 END) OVER w, 0) AS INT) AS ref_start, CAST(coalesce(sum(CASE WHEN op IN ('M', 'I', 'S') THEN len ELSE 0 END) OVER w, 0) AS INT) AS read_start
FROM runs WINDOW w AS (PARTITION BY read_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def cigar_walk(spark, sf_dir):
    ops = sequence.cigar_starts(sequence.cigar_ops(F.col("text")))
    return _runs(spark, sf_dir, _CIGAR).select("read_id", F.posexplode(ops).alias("run", "r")).select("read_id", "run", "r.op", "r.len", "r.ref_start", "r.read_start")


@query(f"""WITH {_RUNS.format(op=_MOVES)}, s AS (SELECT *, CAST(coalesce(sum(CASE WHEN op = 'D' THEN 0 ELSE len END) OVER w, 0) AS INT) AS raw_start,
CAST(coalesce(sum(CASE op WHEN ',' THEN 1 WHEN 'D' THEN len ELSE 0 END) OVER w, 0) AS INT) AS kmer FROM runs
WINDOW w AS (PARTITION BY read_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT read_id, kmer, raw_start, raw_start + len AS raw_end FROM s WHERE op = ','""")
def ss_offsets(spark, sf_dir):
    return _runs(spark, sf_dir, _MOVES).select("read_id", F.explode(sequence.signal_ranges(F.col("text"))).alias("r")).select("read_id", "r.*")


# --- tags and keys -----------------------------------------------------------------------------------------


@query(f"""WITH {UC}, d AS (SELECT read_id, read_pos, prob, read_pos - coalesce(lag(read_pos) OVER (PARTITION BY read_id ORDER BY read_pos) + 1, 0) AS gap FROM uc)
SELECT read_id, 'N+N,' || string_agg(CAST(gap AS VARCHAR), ',' ORDER BY read_pos) || ';' AS mm, string_agg(CAST(CAST(floor(prob * 255) AS INT) AS VARCHAR), ',' ORDER BY read_pos) AS ml FROM d GROUP BY read_id""")
def mm_tag(spark, sf_dir):
    return modtags.read_tags(unique_calls(spark, sf_dir)).select("read_id", "mm", F.array_join(F.col("ml").cast("array<string>"), ",").alias("ml"))


@query(f"WITH {UC} SELECT CAST(floor(prob * 255) AS INT) AS ml, count(*) AS n FROM uc GROUP BY ALL")
def ml_quantise(spark, sf_dir):
    return unique_calls(spark, sf_dir).groupBy(F.floor(F.col("prob") * 255).cast("int").alias("ml")).agg(F.count("*").alias("n"))


@query(f"WITH {UC} SELECT read_id, string_agg(CAST(read_pos AS VARCHAR), ',' ORDER BY read_pos) AS positions FROM uc WHERE prob >= 0.5 GROUP BY read_id")
def modtag_filter(spark, sf_dir):
    got = modtags.read_tags(modtags.drop_unlikely(unique_calls(spark, sf_dir), 0.5))
    return got.select("read_id", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


def _targets(spark, sf_dir):
    return table(spark, sf_dir, "part").where("p_size < 10").selectExpr("concat('P', p_partkey % 50) AS contig", "p_partkey AS pos")


TARGETS = "tg AS (SELECT concat('P', p_partkey % 50) AS contig, p_partkey AS pos FROM part WHERE p_size < 10)"


@query(f"WITH {UC}, {TARGETS} SELECT read_id, string_agg(CAST(read_pos AS VARCHAR), ',' ORDER BY read_pos) AS positions FROM uc SEMI JOIN tg USING (contig, pos) GROUP BY read_id")
def modtag_positions(spark, sf_dir):
    got = modtags.read_tags(modtags.at_positions(unique_calls(spark, sf_dir), _targets(spark, sf_dir)))
    return got.select("read_id", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@query(f"WITH {RC} SELECT DISTINCT concat_ws('_', 'chr_' || contig, pos, ninemer, read_id, read_pos, l_suppkey, base) AS key FROM rc")
def key_build(spark, sf_dir):
    rows = read_calls(spark, sf_dir).withColumn("contig", F.concat(F.lit("chr_"), "contig"))
    return rows.select(sequence.build_key(*[F.col(c) for c in ("contig", "pos", "ninemer", "read_id", "read_pos", "l_suppkey", "base")]).alias("key")).distinct()


@query(f"WITH {RC} SELECT DISTINCT 'chr_' || contig AS contig, CAST(pos AS INT) AS pos, ninemer, CAST(read_id AS VARCHAR) AS read_id, CAST(read_pos AS INT) AS read_pos, CAST(l_suppkey AS INT) AS qscore, base FROM rc")
def key_parse(spark, sf_dir):
    return key_build(spark, sf_dir).select(sequence.parse_key(F.col("key")).alias("k")).select("k.*")


# --- joins and sets ----------------------------------------------------------------------------------------


@query(f"WITH {RC}, {TARGETS} SELECT contig, pos, count(*) AS n FROM rc SEMI JOIN tg USING (contig, pos) GROUP BY ALL")
def target_semi_join(spark, sf_dir):
    return modtags.at_positions(read_calls(spark, sf_dir), _targets(spark, sf_dir)).groupBy("contig", "pos").agg(F.count("*").alias("n"))


@query(f"WITH {RC}, {TARGETS}, n AS (SELECT contig, pos, count(*) AS n FROM rc WHERE prob > 0.9 GROUP BY ALL) SELECT contig, pos, coalesce(n, 0) AS n FROM tg LEFT JOIN n USING (contig, pos)")
def target_counts_left(spark, sf_dir):
    counts = read_calls(spark, sf_dir).where("prob > 0.9").groupBy("contig", "pos").agg(F.count("*").alias("n"))
    return _targets(spark, sf_dir).join(counts, ["contig", "pos"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def missing_reads_anti(spark, sf_dir):
    reads = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(reads, "o_orderkey", "left_anti")


@query(f"WITH {RC} SELECT ninemer FROM rc WHERE prob > 0.95 INTERSECT SELECT ninemer FROM rc WHERE prob < 0.05")
def kmer_intersect(spark, sf_dir):
    calls = read_calls(spark, sf_dir)
    return calls.where("prob > 0.95").select("ninemer").intersect(calls.where("prob < 0.05").select("ninemer"))


@query(f"WITH {RC} SELECT rep, condition, count(*) AS n, count(DISTINCT pos) AS n_sites FROM rc GROUP BY ALL")
def replicate_union(spark, sf_dir):
    calls = read_calls(spark, sf_dir)
    both = calls.where("rep = 'F'").unionByName(calls.where("rep = 'O'"))
    return both.groupBy("rep", "condition").agg(F.count("*").alias("n"), F.countDistinct("pos").alias("n_sites"))


@query(f"WITH {RC} SELECT a.condition, count(*) AS n, round(sum(o_totalprice), 2) AS signal FROM rc a JOIN orders ON o_orderkey = read_id GROUP BY ALL")
def alignment_signal_join(spark, sf_dir):
    signals = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS read_id", "o_totalprice")
    return read_calls(spark, sf_dir).join(signals, "read_id").groupBy("condition").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("signal"))


@query(f"WITH {RC} SELECT ninemer, count(*) AS n FROM rc GROUP BY ALL")
def sorted_counts(spark, sf_dir):
    return read_calls(spark, sf_dir).groupBy("ninemer").agg(F.count("*").alias("n")).orderBy("ninemer")


@query(f"WITH {RC} SELECT ninemer, count(*) AS n FROM rc GROUP BY ALL ORDER BY n DESC, ninemer LIMIT 5")
def limit_topk(spark, sf_dir):
    return read_calls(spark, sf_dir).groupBy("ninemer").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ninemer").limit(5)


# --- training data -------------------------------------------------------------------------------------------


@query(f"""WITH {RC}, r AS (SELECT ninemer, read_id, read_pos, l_suppkey, row_number() OVER (PARTITION BY ninemer ORDER BY read_id, read_pos, l_suppkey) AS i, least(count(*) OVER (PARTITION BY ninemer), 30) AS m FROM rc)
SELECT ninemer, CASE WHEN i <= CAST(0.6 AS DOUBLE) * m THEN 'train' WHEN i <= CAST(0.8 AS DOUBLE) * m THEN 'validation' ELSE 'test' END AS split, count(*) AS n, sum(read_id) AS reads FROM r WHERE i <= 30 GROUP BY ALL""")
def stratified_split(spark, sf_dir):
    got = training.stratified_split(read_calls(spark, sf_dir), ["ninemer"], ["read_id", "read_pos", "l_suppkey"], 30)
    return got.groupBy("ninemer", "split").agg(F.count("*").alias("n"), F.sum("read_id").alias("reads"))


@query("""WITH u AS (SELECT doc_id, quality, CAST('0x' || substr(md5(concat_ws(':', 1, doc_id)), 1, 8) AS BIGINT) % 100 AS u FROM labels)
SELECT doc_id, quality, CASE WHEN u < 60 THEN 'train' WHEN u < 80 THEN 'validation' ELSE 'test' END AS split FROM u""")
def random_split_hash(spark, sf_dir):
    return training.random_split(table(spark, sf_dir, "labels").select("doc_id", "quality"), F.col("doc_id"))


@query(f"WITH {RC} SELECT CASE WHEN prob > 0.9 THEN 1 ELSE 0 END AS label, count(*) AS n FROM rc WHERE prob > 0.9 OR prob < 0.1 GROUP BY ALL")
def assemble_labels(spark, sf_dir):
    calls = read_calls(spark, sf_dir)
    return training.assemble(calls.where("prob > 0.9"), calls.where("prob < 0.1")).groupBy("label").agg(F.count("*").alias("n"))


def _hash_sql(n, *parts):
    return f"CAST('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8) AS BIGINT) % {n}"


def _mixture_sql(kind: str) -> str:
    k = "floor(v * n / 200)" if kind == "wt_added" else "floor(v * n / 100)"
    mod, mid = ("floor(s * n / 100)", "0") if kind == "ko" else (k, k if kind == "wt_added" else "0")
    low, a, b = (50, 0.5, 0.5) if kind == "ko" else (92, 0.2, 0.6)
    again = "CASE WHEN t > 0 THEN t END"
    pick = """SELECT kmer, round, '{o}' AS origin, prob, base FROM (SELECT s.kmer, p.round, s.prob, s.base, row_number() OVER (PARTITION BY s.kmer, p.round ORDER BY md5(concat_ws(':', '{k}{o}', p.round, s.id)), s.id) AS r, {need} AS need
  FROM src s JOIN p USING (kmer) WHERE s.side = '{o}') WHERE r <= need"""
    return f"""WITH {RC}, src AS (SELECT concat(contig, '-', l_suppkey % 7 * (l_partkey % 9)) AS kmer, concat_ws('-', read_id, read_pos, l_partkey, l_suppkey) AS id, prob, base, CASE WHEN prob > 0.6 THEN 'mod' ELSE 'unmod' END AS side FROM rc WHERE prob > 0.6 OR prob < 0.4),
km AS (SELECT kmer, count(*) FILTER (WHERE side = 'mod') AS have_mod, count(*) FILTER (WHERE side = 'unmod') AS have_unmod FROM src GROUP BY kmer HAVING have_mod > 0 AND have_unmod > 0),
raw AS (SELECT km.*, round, t, {_hash_sql(990, f"'{kind}n'", "kmer", "round", again)} + 10 AS n, {_hash_sql(90, f"'{kind}s'", "kmer", "round", again)} + 10 AS s, {_hash_sql(8, f"'{kind}v'", "kmer", "round", again)} AS v
  FROM km CROSS JOIN (SELECT range AS round FROM range(2)) CROSS JOIN (SELECT range AS t FROM range(50))),
p AS (SELECT kmer, round, n, {mod} AS n_mod, {mid} AS n_mid FROM raw WHERE n_mod <= have_mod AND n - n_mod - n_mid <= have_unmod QUALIFY row_number() OVER (PARTITION BY kmer, round ORDER BY t) = 1),
f AS (SELECT DISTINCT kmer, round FROM raw EXCEPT SELECT kmer, round FROM p),
parts AS ({pick.format(o="mod", k=kind, need="p.n_mod")} UNION ALL {pick.format(o="unmod", k=kind, need="p.n - p.n_mod - p.n_mid")}
  UNION ALL SELECT kmer, round, 'mid', 0.2 + CAST(0.6 AS DOUBLE) * ({_hash_sql(1000000, "'mid'", "kmer", "round", "i")}) / 1000000, substr('ACGT', CAST({_hash_sql(4, "'base'", "kmer", "round", "i")} + 1 AS INT), 1) FROM p CROSS JOIN (SELECT range AS i FROM range(1, 1000)) WHERE i <= n_mid
  UNION ALL SELECT kmer, round, 'fallback', CASE WHEN i <= {low} THEN CAST(0.1 AS DOUBLE) * u ELSE {a} + CAST({b} AS DOUBLE) * u END, 'A' FROM (SELECT *, CAST({_hash_sql(1000000, "'fallback'", "kmer", "round", "i")} AS DOUBLE) / 1000000 AS u FROM f CROSS JOIN (SELECT range AS i FROM range(1, 101))))
SELECT kmer, CAST(round AS INT) AS round, origin, count(*) AS n, count(*) FILTER (WHERE base = 'A') AS n_a, round(sum(prob), 8) AS total FROM parts GROUP BY ALL"""


def _mixture(spark, sf_dir, kind):
    kmer = F.concat("contig", F.lit("-"), F.expr("l_suppkey % 7 * (l_partkey % 9)"))  # groups of many sizes, some of them too small for any plan
    rows = read_calls(spark, sf_dir).select(kmer.alias("kmer"), F.concat_ws("-", *[F.col(c).cast("string") for c in ("read_id", "read_pos", "l_partkey", "l_suppkey")]).alias("id"), "prob", "base")
    got = training.mixtures(rows.where("prob > 0.6"), rows.where("prob < 0.4"), kind, 2)
    return got.groupBy("kmer", "round", "origin").agg(F.count("*").alias("n"), F.count_if(F.col("base") == "A").alias("n_a"), F.round(F.sum("prob"), 8).alias("total"))


@query(_mixture_sql("ko"))
def mixture_ko(spark, sf_dir):
    return _mixture(spark, sf_dir, "ko")


@query(_mixture_sql("wt_added"))
def mixture_wt_added(spark, sf_dir):
    return _mixture(spark, sf_dir, "wt_added")


@query(_mixture_sql("wt_simple"))
def mixture_wt_simple(spark, sf_dir):
    return _mixture(spark, sf_dir, "wt_simple")


# --- metrics -------------------------------------------------------------------------------------------------


@query(f"""WITH {PAIRS}, v AS (SELECT wt AS x, 1 AS a, 0 AS b FROM pairs UNION ALL SELECT ivt, 0, 1 FROM pairs), g AS (SELECT x, sum(a) AS a, sum(b) AS b FROM v GROUP BY x),
c AS (SELECT sum(a) OVER w / sum(a) OVER () - sum(b) OVER w / sum(b) OVER () AS gap FROM g WINDOW w AS (ORDER BY x)) SELECT round(max(abs(gap)), 4) AS ks_d FROM c""")
def metric_ks(spark, sf_dir):
    return metrics.ks_distance(pairs(spark, sf_dir))




@query(f"""WITH {PAIRS}, v AS (SELECT wt AS x FROM pairs UNION ALL SELECT ivt FROM pairs), e AS (SELECT quantile_cont(x, 0.9) AS e10, quantile_cont(x, 0.95) AS e5, quantile_cont(x, 0.99) AS e1 FROM v),
f AS (SELECT {", ".join(f"count(*) FILTER (WHERE wt >= e{k}) / nullif(count(*) FILTER (WHERE ivt >= e{k}), 0) AS odds{k}" for k in (10, 5, 1))} FROM pairs CROSS JOIN e)
SELECT round(odds10, 9) AS odds10, round(odds5, 9) AS odds5, round(odds1, 9) AS odds1 FROM f""")
def metric_topk_odds(spark, sf_dir):
    return metrics.top_odds(pairs(spark, sf_dir), [10, 5, 1]).select(*[F.round(c, 9).alias(c) for c in ("odds10", "odds5", "odds1")])


@query(f"WITH {PAIRS} SELECT round(corr(wt, ivt), 3) AS pearsonr FROM pairs")
def metric_pearson(spark, sf_dir):
    return metrics.pearson(pairs(spark, sf_dir))


@query(f"""WITH {PAIRS}, r AS (SELECT rank() OVER (ORDER BY wt) + (count(*) OVER (PARTITION BY wt) - 1) / 2 AS a, rank() OVER (ORDER BY ivt) + (count(*) OVER (PARTITION BY ivt) - 1) / 2 AS b FROM pairs)
SELECT round(corr(a, b), 3) AS spearmanr FROM r""")
def metric_spearman(spark, sf_dir):
    return metrics.spearman(pairs(spark, sf_dir))


@query(f"WITH {PAIRS} SELECT round(avg(wt - ivt), 3) AS avg_delta_stoich FROM pairs")
def metric_mean_delta(spark, sf_dir):
    return metrics.mean_delta(pairs(spark, sf_dir))


# --- scorers and streams ---------------------------------------------------------------------------------------


@query(f"WITH {NINE} SELECT read_id, start, ninemer, round((36 * total + CAST(177.5 AS DOUBLE)) / 180, 6) AS level FROM nine WHERE substr(ninemer, 5, 1) = 'A'")
def read_score_arrow(spark, sf_dir):
    flat = F.flatten(F.transform("five", lambda e: signal.resample(e["samples"])))
    wide = _nine(spark, sf_dir, "A").select("read_id", "start", "ninemer", flat.alias("features"))
    scored = sites.score(wide, "features", "level", lambda x: x.mean(axis=1))
    return scored.select("read_id", "start", "ninemer", F.round("level", 6).alias("level"))


COUNTS = f"WITH {RC} SELECT pos, count(*) AS coverage, count(*) FILTER (WHERE prob > 0.5) AS n_mod, count(*) FILTER (WHERE prob < 0.5) AS n_unmod, CAST(sum(least(CAST(floor(prob * 100) AS INT), 99)) AS BIGINT) AS bin_sum FROM rc GROUP BY pos"


def _stream(spark, sf_dir):
    from ..scratch import shared_folder

    folder = shared_folder(spark)
    calls = read_calls(spark, sf_dir).select("pos", "prob")
    calls.repartition(7).write.parquet(f"{folder}/chunks")  # several chunks, so that batches and merges take place
    return chunks.drain_sites(chunks.chunk_stream(spark, f"{folder}/chunks", calls.schema, 2), f"{folder}/run", ["pos"], 3)


@query(COUNTS)
def stream_chunk_counts(spark, sf_dir):
    return _stream(spark, sf_dir)


@query(f"SELECT pos, true AS equal FROM ({COUNTS})")
def stream_vs_batch_site(spark, sf_dir):
    batch = chunks.site_counts(read_calls(spark, sf_dir), ["pos"])
    names = ["coverage", "n_mod", "n_unmod", "bin_sum"]
    stream = _stream(spark, sf_dir).select("pos", *[F.col(c).alias(f"s_{c}") for c in names])
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"s_{c}"))
    return batch.join(stream, "pos", "full").select("pos", same.alias("equal"))


from . import coverage, formats, streams  # noqa: E402, F401  further queries register themselves
