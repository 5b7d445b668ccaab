"""Queries of loci, annotations, frames, seqlets and matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import annotate, loci, match, motifmatch, plotdata, seqlets, signals, windows
from helixframe.operators.order import checkpointed
from helixframe.plans import views
from helixframe.plans.catalog import query
from helixframe.plans.sequences import MOTIFS, motif_columns

BASE = (views.TILES, views.LOCI)


@query("""SELECT chrom, count(*) AS n, CAST(sum("end" - "start") AS BIGINT) AS width FROM loci WHERE chrom IN ('chr1', 'chr2', 'chr3') GROUP BY chrom""", views.LOCI)
def l03_chromosome_filter(spark, sf_dir):
    """L3: loci of some chromosomes."""
    some = views.loci(spark, sf_dir).where(F.col("chrom").isin("chr1", "chr2", "chr3"))
    return some.groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("width"))


@query(
    """SELECT (row_number() OVER (ORDER BY locus_idx) - 1) * 2 AS locus_idx, 0 AS source, chrom, "start", "end" FROM loci WHERE locus_idx % 2 = 0 AND chrom <> 'chr0'
    UNION ALL SELECT (row_number() OVER (ORDER BY locus_idx) - 1) * 2 + 1, 1, chrom, "start", "end" FROM loci WHERE locus_idx % 2 = 1 AND chrom <> 'chr0'""",
    views.LOCI,
)
def l02_interleave(spark, sf_dir):
    """L2: two lists of loci dealt out in turn."""
    rows = views.loci(spark, sf_dir).withColumn("row", F.col("locus_idx"))
    return loci.interleave([rows.where("locus_idx % 2 = 0"), rows.where("locus_idx % 2 = 1")], [f"chr{i}" for i in range(1, 7)])


IN = """kept AS (SELECT l.* FROM loci l JOIN sizes USING (chrom) WHERE "start" + ("end" - "start") // 2 - 50 >= 0 AND "start" + ("end" - "start") // 2 + 50 <= size)"""


@query("SELECT * FROM kept", *BASE, IN)
def l04_boundary(spark, sf_dir):
    """L4: loci whose window of 101 lies inside the chromosome."""
    return loci.inside(views.loci(spark, sf_dir), views.sizes(spark, sf_dir), 101).select("locus_idx", "chrom", "start", "end")


FREE = """covered AS (SELECT DISTINCT chrom, b FROM (SELECT chrom, unnest(generate_series("start" // 100, "end" // 100)) AS b FROM zones)),
free AS (SELECT * FROM loci l WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.chrom = l.chrom AND c.b BETWEEN l."start" // 100 AND l."end" // 100))"""


@query("SELECT * FROM free", views.LOCI, views.ZONES, FREE)
def l05_exclusion(spark, sf_dir):
    """Loci that no excluded zone touches."""
    return loci.exclude(views.loci(spark, sf_dir), views.zones(spark, sf_dir)).select("locus_idx", "chrom", "start", "end")


SPAN = """win AS (SELECT *, "start" + ("end" - "start") // 2 - 50 AS s, "start" + ("end" - "start") // 2 + 50 AS e FROM loci),
totals AS (SELECT locus_idx, track, sum(coalesce(CASE WHEN isnan(value) THEN 0 ELSE value END, 0)) AS total FROM win JOIN signal g ON g.chrom = win.chrom AND pos >= s AND pos < e GROUP BY 1, 2)"""


@query("SELECT locus_idx, track, total FROM totals", views.LOCI, views.SIGNAL, SPAN)
def l07_signal_sums(spark, sf_dir):
    """Signal of each track in a window around each locus, by an interval join."""
    return loci.signal_sums(loci.window(views.loci(spark, sf_dir), 100), views.signal(spark, sf_dir), 128)


@query("""SELECT l.* FROM loci l LEFT JOIN (SELECT * FROM totals WHERE track = 'click') USING (locus_idx) WHERE coalesce(total, 0) BETWEEN 1 AND 50000""", views.LOCI, views.SIGNAL, SPAN)
def l06_count_filter(spark, sf_dir):
    """Loci with some, but not too much, signal."""
    some = views.loci(spark, sf_dir)
    totals = loci.signal_sums(loci.window(some, 100), views.signal(spark, sf_dir), 128)
    return loci.count_filter(some, totals, "click", 1, 50_000)


@query("""SELECT locus_idx, chrom, "start" + summit - ("end" - "start") // 2 AS "start", "start" + summit + ("end" - "start") // 2 AS "end" FROM (SELECT *, locus_idx % 7 % ("end" - "start") AS summit FROM loci)""", views.LOCI)
def l09_summits(spark, sf_dir):
    """Loci moved to their summits."""
    some = views.loci(spark, sf_dir).withColumn("summit", F.col("locus_idx") % 7 % (F.col("end") - F.col("start")))
    return loci.recenter(some, "summit").select("locus_idx", "chrom", "start", "end")


GENOME = "genome AS (SELECT chrom, string_agg(seq, '' ORDER BY tile_start) AS g FROM tiles GROUP BY chrom)"
FREE_WINDOW = """free_window AS (SELECT * FROM kept l WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.chrom = l.chrom
  AND c.b BETWEEN (l."start" + (l."end" - l."start") // 2 - 50) // 100 AND (l."start" + (l."end" - l."start") // 2 + 50) // 100))"""
CUT = """cut AS (SELECT locus_idx, chrom, "start" + ("end" - "start") // 2 - 50 AS win_start, "start" + ("end" - "start") // 2 + 51 AS win_end FROM free_window)"""


@query("SELECT locus_idx, chrom, win_start, win_end, substring(g, CAST(win_start + 1 AS BIGINT), 101) AS seq FROM cut JOIN genome USING (chrom)", *BASE, views.ZONES, FREE, IN, GENOME, FREE_WINDOW, CUT)
def l01_extract_loci(spark, sf_dir):
    """L1: sequences of windows of 101 around all loci that pass the filters."""
    return loci.extract_loci(views.loci(spark, sf_dir), views.tiles(spark, sf_dir), views.sizes(spark, sf_dir), tile=views.TILE, in_window=101, zones=views.zones(spark, sf_dir))


@query("SELECT locus_idx, chrom, win_start, win_end, substring(g, CAST(win_start + 1 AS BIGINT), 101) AS seq FROM (SELECT * FROM cut ORDER BY locus_idx LIMIT 100) JOIN genome USING (chrom)", *BASE, views.ZONES, FREE, IN, GENOME, FREE_WINDOW, CUT)
def l10_first_loci(spark, sf_dir):
    """The first hundred loci that pass, as the limit asks for."""
    return loci.extract_loci(views.loci(spark, sf_dir), views.tiles(spark, sf_dir), views.sizes(spark, sf_dir), tile=views.TILE, in_window=101, zones=views.zones(spark, sf_dir), n_loci=100)


@query(
    "SELECT locus_idx, locus_idx IN (SELECT locus_idx FROM free_window) AS kept FROM loci WHERE locus_idx <= (SELECT max(locus_idx) FROM (SELECT locus_idx FROM free_window ORDER BY locus_idx LIMIT 100))",
    *BASE,
    views.ZONES,
    FREE,
    IN,
    FREE_WINDOW,
)
def l11_mask_of_first(spark, sf_dir):
    """Which loci passed, up to the last one that the limit needs."""
    return loci.extract(views.loci(spark, sf_dir), views.tiles(spark, sf_dir), views.sizes(spark, sf_dir), tile=views.TILE, in_window=101, zones=views.zones(spark, sf_dir), n_loci=100).mask


EXTRACT = """mids AS (SELECT locus_idx, l.chrom, "start" + ("end" - "start") // 2 AS mid FROM loci l JOIN sizes USING (chrom) WHERE "start" + ("end" - "start") // 2 - 30 >= 0 AND "start" + ("end" - "start") // 2 + 30 <= size),
pieces AS (SELECT DISTINCT m.chrom, m.mid, g.track, g."start", g."end", g.value, event FROM (SELECT DISTINCT chrom, mid FROM mids) m JOIN (SELECT *, row_number() OVER () AS event FROM intervals) g ON g.chrom = m.chrom AND g."start" < m.mid + 30 AND g."end" > m.mid - 30),
counted AS (SELECT chrom, mid, sum(value * (least("end", mid + 20) - greatest("start", mid - 20))) AS total FROM pieces WHERE track = 'click' AND "start" < mid + 20 AND "end" > mid - 20 GROUP BY 1, 2),
picked AS (SELECT m.*, t.total FROM mids m JOIN counted t USING (chrom, mid) WHERE total >= 500 AND total <= 900000),
profile AS (SELECT chrom, mid, track, p, sum(value) AS v FROM pieces, generate_series(-30, 29) AS t(p) WHERE mid + p >= "start" AND mid + p < "end" GROUP BY ALL)"""


@query(
    """SELECT locus_idx, chrom, mid - 30 AS win_start, mid + 30 AS win_end, substring(g, CAST(mid - 29 AS BIGINT), 60) AS seq,
    coalesce((SELECT string_agg(track || p || '=' || CAST(v AS BIGINT), ',' ORDER BY track, p) FROM profile f WHERE f.chrom = k.chrom AND f.mid = k.mid AND p BETWEEN -20 AND 19 AND v <> 0 AND track IN ('click', 'purchase')), '') AS signals,
    coalesce((SELECT string_agg(track || p || '=' || CAST(v AS BIGINT), ',' ORDER BY track, p) FROM profile f WHERE f.chrom = k.chrom AND f.mid = k.mid AND v <> 0 AND track = 'click'), '') AS in_signals
    FROM picked k JOIN genome USING (chrom)""",
    *BASE,
    views.INTERVALS,
    GENOME,
    EXTRACT,
)
def s10_extract_signals(spark, sf_dir):
    """Sequences, two output tracks and an input track of loci with some but not too much signal; profiles as their places and values that aren't zero."""
    signal = views.intervals(spark, sf_dir)
    out = loci.extract_loci(
        views.loci(spark, sf_dir), views.tiles(spark, sf_dir), views.sizes(spark, sf_dir), tile=views.TILE, in_window=60, out_window=40,
        signals=signal, tracks=["click", "purchase"], in_signals=signal, in_tracks=["click"], min_counts=500, max_counts=900_000,
    )
    told = lambda values, track, half: F.filter(F.transform(values, lambda v, p: F.when(v != 0, F.concat(F.lit(track), (p - half).cast("string"), F.lit("="), v.cast("long").cast("string")))), lambda x: x.isNotNull())
    both = F.concat(*[told(F.col("signals")[i], t, 20) for i, t in enumerate(("click", "purchase"))])
    return out.select("locus_idx", "chrom", "win_start", "win_end", "seq", F.array_join(both, ",").alias("signals"), F.array_join(told(F.col("in_signals")[0], "click", 30), ",").alias("in_signals"))


@query(
    """SELECT locus_idx, track, coalesce((SELECT sum(value * (least(g."end", e) - greatest(g."start", s))) FROM intervals g WHERE g.chrom = w.chrom AND g.track = t.track AND g."start" < e AND g."end" > s), 0) AS total
    FROM (SELECT locus_idx, chrom, "start" + ("end" - "start") // 2 - 250 AS s, "start" + ("end" - "start") // 2 + 250 AS e FROM loci) w, (VALUES ('click'), ('view')) AS t(track)""",
    views.LOCI,
    views.INTERVALS,
)
def l07_interval_sums(spark, sf_dir):
    """Sums of two tracks over windows of 500, by prefix sums."""
    return signals.interval_sums(loci.window(views.loci(spark, sf_dir), 500), views.intervals(spark, sf_dir), ["click", "view"], tile=512)


@query("SELECT locus_idx, k.locus_idx IS NOT NULL AS kept FROM loci l LEFT JOIN kept k USING (locus_idx)".replace("SELECT locus_idx, k.locus_idx IS NOT NULL", "SELECT l.locus_idx, k.locus_idx IS NOT NULL").replace("USING (locus_idx)", "ON l.locus_idx = k.locus_idx"), *BASE, IN)
def l11_mask(spark, sf_dir):
    """For every locus whether it stays."""
    some = views.loci(spark, sf_dir)
    return loci.kept_mask(some, loci.inside(some, views.sizes(spark, sf_dir), 101))


@query(
    """SELECT l.chrom, l."start" + (l."end" - l."start") // 2 - 150 + a."start" - 1 AS "start", l."start" + (l."end" - l."start") // 2 - 150 + a."end" - 1 AS "end", annotation_idx
    FROM annotations a JOIN loci l ON a.example_idx * 8 + 1 = l.locus_idx""",
    views.LOCI,
    views.ANNOTATIONS,
)
def l12_example_to_genome(spark, sf_dir):
    """Spans of examples in coordinates of the genome, counted from one."""
    spans = views.annotations(spark, sf_dir).withColumn("example_idx", F.col("example_idx") * 8 + 1)
    return loci.to_genome(spans, views.loci(spark, sf_dir), 300, one_indexed=True)


@query(
    """SELECT s.example_idx, s."start", s."end", coalesce(sum(value), 0) AS total FROM (SELECT row_number() OVER () AS r, example_idx, "start" % 32 AS "start", "start" % 32 + ("end" - "start") AS "end" FROM annotations) s
    JOIN attr a ON a.example_idx = s.example_idx AND a.pos >= s."start" AND a.pos < s."end" GROUP BY r, s.example_idx, s."start", s."end\"""",
    views.ANNOTATIONS,
    views.ATTR,
)
def l13_extract_signal(spark, sf_dir):
    """Attribution of each span."""
    spans = views.annotations(spark, sf_dir).select("example_idx", (F.col("start") % 32).cast("int").alias("start"), (F.col("start") % 32 + F.col("end") - F.col("start")).cast("int").alias("end"))
    return loci.extract_signal(spans, views.tracks(spark, sf_dir))


@query("SELECT coalesce(example_idx, -1) AS example_idx, coalesce(annotation_idx, -1) AS annotation_idx, count(*) AS n FROM annotations GROUP BY GROUPING SETS ((annotations.example_idx, annotations.annotation_idx), (annotations.annotation_idx), (annotations.example_idx))", views.ANNOTATIONS)
def a01_count_annotations(spark, sf_dir):
    """A1: counts of annotations for all three shapes in one pass; -1 for what is summed over."""
    counts = annotate.count_annotations(views.annotations(spark, sf_dir))
    return counts.select(F.coalesce("example_idx", F.lit(-1)).alias("example_idx"), F.coalesce("annotation_idx", F.lit(-1)).alias("annotation_idx"), "n")


@query("SELECT example_idx, " + ", ".join(f"count(*) FILTER (WHERE annotation_idx = {i}) AS a{i}" for i in range(7)) + " FROM annotations GROUP BY example_idx", views.ANNOTATIONS)
def a01_count_matrix(spark, sf_dir):
    """A1: the dense form, a column for each annotation."""
    return annotate.count_matrix(views.annotations(spark, sf_dir), 7)


@query("SELECT a.annotation_idx AS a, b.annotation_idx AS b, count(*) AS n FROM (SELECT DISTINCT example_idx, annotation_idx FROM annotations) a JOIN (SELECT DISTINCT example_idx, annotation_idx FROM annotations) b USING (example_idx) WHERE a.annotation_idx <> b.annotation_idx GROUP BY 1, 2", views.ANNOTATIONS)
def a02_pairs_unique(spark, sf_dir):
    """A2: pairs of different annotations in an example, each pair once an example."""
    return annotate.pair_counts(views.annotations(spark, sf_dir))


ROWS = """rows_ AS (SELECT *, row_number() OVER (PARTITION BY example_idx ORDER BY "start", "end", annotation_idx) AS r FROM annotations)"""


@query(
    """SELECT a, b, sum(n)::BIGINT AS n FROM (SELECT x.annotation_idx AS a, y.annotation_idx AS b, 1 AS n FROM rows_ x JOIN rows_ y ON x.example_idx = y.example_idx AND x.r < y.r
    UNION ALL SELECT y.annotation_idx, x.annotation_idx, 1 FROM rows_ x JOIN rows_ y ON x.example_idx = y.example_idx AND x.r < y.r WHERE x.annotation_idx <> y.annotation_idx) GROUP BY 1, 2""",
    views.ANNOTATIONS,
    ROWS,
)
def a02_pairs_all(spark, sf_dir):
    """A2: all pairs of annotations in an example, either way round."""
    return annotate.pair_counts(views.annotations(spark, sf_dir), unique=False)


@query("SELECT x.annotation_idx AS a, y.annotation_idx AS b, count(*) AS n FROM rows_ x JOIN rows_ y ON x.example_idx = y.example_idx AND x.r < y.r GROUP BY 1, 2", views.ANNOTATIONS, ROWS)
def a02_pairs_ordered(spark, sf_dir):
    """A2: pairs of annotations in an example by order along it."""
    rows = views.annotations(spark, sf_dir).withColumn("place", F.struct("start", "end", "annotation_idx"))
    return annotate.pair_counts(rows, unique=False, symmetric=False, order="place")


@query(
    """SELECT a, b, distance, CAST(sum(n) AS BIGINT) AS n FROM (SELECT x.annotation_idx AS a, y.annotation_idx AS b, y."start" - x."end" AS distance, 1 AS n FROM annotations x JOIN annotations y ON x.example_idx = y.example_idx AND y."start" >= x."end" AND y."start" - x."end" < 50
    UNION ALL SELECT y.annotation_idx, x.annotation_idx, y."start" - x."end", 1 FROM annotations x JOIN annotations y ON x.example_idx = y.example_idx AND y."start" >= x."end" AND y."start" - x."end" < 50 WHERE x.annotation_idx <> y.annotation_idx) GROUP BY 1, 2, 3""",
    views.ANNOTATIONS,
)
def a03_spacing(spark, sf_dir):
    """A3: pairs by spacing below 50, by a band join."""
    return annotate.spacing_counts(views.annotations(spark, sf_dir), 50)


@query("SELECT example_idx, pos, total FROM (SELECT example_idx, pos, sum(value) OVER w AS total, count(*) OVER w AS n FROM attr WINDOW w AS (PARTITION BY example_idx ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)) WHERE n = 8", views.ATTR)
def w01_sliding_sum(spark, sf_dir):
    """Sums of 8 positions."""
    return windows.sliding_sum(views.attr(spark, sf_dir), 8)


@query("SELECT example_idx, pos, sum(value) OVER (PARTITION BY example_idx ORDER BY pos) AS total FROM attr", views.ATTR)
def w02_prefix_sum(spark, sf_dir):
    """Running sums."""
    return windows.prefix_sum(views.attr(spark, sf_dir))


@query("SELECT example_idx, pos, max(value) OVER (PARTITION BY example_idx ORDER BY pos) AS value FROM attr", views.ATTR)
def w03_running_max(spark, sf_dir):
    """Running maxima."""
    return windows.running_max(views.attr(spark, sf_dir), ["example_idx"], "pos", "value")


@query("SELECT * FROM (SELECT example_idx, pos, value, CAST(row_number() OVER (PARTITION BY example_idx ORDER BY abs(value) DESC, pos) AS INT) AS rank FROM attr) WHERE rank <= 5", views.ATTR)
def w05_top_positions(spark, sf_dir):
    """The five strongest positions of each example."""
    return windows.top_k(views.attr(spark, sf_dir), ["example_idx"], [F.desc(F.abs("value")), "pos"], 5)


@query("SELECT pos, round(quantile_cont(value, 0.01), 6) AS q0, round(quantile_cont(value, 0.5), 6) AS q1, round(quantile_cont(value, 0.9), 6) AS q2 FROM attr GROUP BY pos", views.ATTR)
def w06_quantiles(spark, sf_dir):
    """Quantiles of each position."""
    q = windows.quantiles(views.attr(spark, sf_dir), "value", [0.01, 0.5, 0.9], ["pos"])
    return q.select("pos", *[F.round(f"q{i}", 6).alias(f"q{i}") for i in range(3)])


@query("SELECT CAST(least(floor((value + 1000) / 20), 99) AS INT) AS bin, count(*) AS n FROM attr WHERE value BETWEEN -1000 AND 1000 GROUP BY 1", views.ATTR)
def w07_histogram(spark, sf_dir):
    """A histogram of a hundred bins."""
    return windows.histogram(views.attr(spark, sf_dir), "value", -1000.0, 1000.0, 100)


@query("SELECT pos, round(avg(CASE WHEN abs(value) < 100 THEN 1.0 ELSE 0.0 END), 9) AS share FROM attr GROUP BY pos", views.ATTR)
def w08_empirical_rank(spark, sf_dir):
    """Share of weaker values at each position."""
    return windows.empirical_rank(views.attr(spark, sf_dir), "value", 100.0, ["pos"]).select("pos", F.round("share", 9).alias("share"))


@query()
def q01_recursive_seqlets(spark, sf_dir):
    """Q1: spans significant together with all that they nest."""
    return seqlets.recursive_seqlets(views.tracks(spark, sf_dir), threshold=0.05)


@query("SELECT CAST(floor((value - low) / width) AS INT) AS bin, count(*) AS n FROM attr, (SELECT min(value) AS low, (max(value) - min(value)) / 999 AS width FROM attr) GROUP BY 1", views.ATTR)
def q01_null_histogram(spark, sf_dir):
    """Q1: the histogram its null comes from."""
    values = views.attr(spark, sf_dir)
    low, high = values.agg(F.min("value"), F.max("value")).first()
    return values.groupBy(F.floor((F.col("value") - low) / ((high - low) / 999)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query()
def q05_tfmodisco_seqlets(spark, sf_dir):
    """Q2 to Q5: windows that stand out from a Laplace null at a false discovery rate."""
    return seqlets.tfmodisco_seqlets(views.tracks(spark, sf_dir), window=8, flank=3)


@query()
def q06_annotate_seqlets(spark, sf_dir):
    """Q6: the two nearest of all motifs to each annotated span of the documents' sequences."""
    both = views.annotations(spark, sf_dir).join(views.doc_seqs(spark, sf_dir), "example_idx")
    name = F.concat_ws(":", "example_idx", "annotation_idx", "start", "end").alias("seqlet_idx")
    some = both.select(name, F.substring("seq", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")).alias("seq"))
    return motifmatch.annotate_seqlets(some, motif_columns(spark, sf_dir), n_nearest=2)


@query("SELECT chrom, CAST(s AS BIGINT) AS \"start\", CAST(s + 100 AS BIGINT) AS \"end\" FROM sizes, unnest(generate_series(0, size - 100, 100)) AS t(s)", views.TILES)
def g01_tiles(spark, sf_dir):
    """Adjacent tiles of each chromosome."""
    return match.chromosome_tiles(views.sizes(spark, sf_dir), 100)


BINS = "bins AS (SELECT chrom, tile_start, n, gc, CAST(round((gc + 0.02::DOUBLE - (gc + 0.02::DOUBLE) % 0.04::DOUBLE) / 0.04::DOUBLE) AS INT) AS gc_bin FROM (SELECT chrom, tile_start, len(regexp_extract_all(seq, 'N')) / 64.0::DOUBLE AS n, len(regexp_extract_all(seq, '[GC]')) / 64.0::DOUBLE AS gc FROM tiles))"


@query("SELECT gc_bin, count(*) AS n FROM bins WHERE n <= 0.1 GROUP BY gc_bin", views.TILES, BINS)
def g06_gc_bins(spark, sf_dir):
    """Tiles with few unknown letters by GC bin."""
    return match.gc_profile(views.tiles(spark, sf_dir), 0.1, 0.04).groupBy("gc_bin").agg(F.count(F.lit(1)).alias("n"))


#: The quotas as a recursion over (bin from the highest down, distance, above before below).
MATCHING = """targets AS (SELECT chrom, "start", "end", substring(g, CAST("start" + 43 + 1 AS BIGINT), 64) AS seq FROM zones JOIN sizes USING (chrom) JOIN genome USING (chrom) WHERE "start" + 43 >= 0 AND "start" + 107 <= size),
shares AS (SELECT len(regexp_extract_all(seq, 'N')) / 64.0::DOUBLE AS n, len(regexp_extract_all(seq, '[GC]')) / 64.0::DOUBLE + 0.02::DOUBLE AS x FROM targets),
wanted AS (SELECT CAST(round((x - x % 0.04::DOUBLE) / 0.04::DOUBLE) AS INT) AS b, count(*) AS n FROM shares WHERE n < 0.1 GROUP BY 1),
touched AS (SELECT DISTINCT chrom, t * 64 AS tile_start FROM targets, unnest(generate_series("start" // 64, "end" // 64)) AS s(t)),
free AS (SELECT chrom, tile_start, gc_bin, row_number() OVER (PARTITION BY gc_bin ORDER BY md5('0:' || chrom || ':' || tile_start), chrom, tile_start) AS rn FROM bins
  WHERE n <= 0.1 AND chrom IN (SELECT chrom FROM targets) AND NOT EXISTS (SELECT 1 FROM touched t WHERE t.chrom = bins.chrom AND t.tile_start = bins.tile_start)),
have AS (SELECT gc_bin AS b, count(*) AS n FROM free GROUP BY 1),
grid AS (SELECT list(least(coalesce(w.n, 0), coalesce(h.n, 0)) ORDER BY i) AS take, list(coalesce(h.n, 0) - least(coalesce(w.n, 0), coalesce(h.n, 0)) ORDER BY i) AS spare, list(coalesce(w.n, 0) - least(coalesce(w.n, 0), coalesce(h.n, 0)) ORDER BY i) AS need
  FROM range(26) r(i) LEFT JOIN wanted w ON w.b = i LEFT JOIN have h ON h.b = i),
steps AS (SELECT row_number() OVER (ORDER BY b DESC, d, sign DESC) AS k, b + 1 AS b, b + d * sign + 1 AS other FROM range(26) x(b), range(1, 26) y(d), (VALUES (1), (-1)) z(sign)),
walk AS (
  WITH RECURSIVE w AS (
    SELECT 0::BIGINT AS k, take, spare, need FROM grid
    UNION ALL
    SELECT s.k, list_transform(take, lambda x, i: CASE WHEN i = other THEN x + m ELSE x END), list_transform(spare, lambda x, i: CASE WHEN i = other THEN x - m ELSE x END), list_transform(need, lambda x, i: CASE WHEN i = s.b THEN x - m ELSE x END)
    FROM w JOIN steps s ON s.k = w.k + 1, LATERAL (SELECT CASE WHEN other BETWEEN 1 AND 26 THEN least(need[s.b], spare[other]) ELSE 0 END AS m) l)
  SELECT take FROM w ORDER BY k DESC LIMIT 1)"""


@query('SELECT chrom, tile_start AS "start", tile_start + 64 AS "end", gc_bin FROM free, walk WHERE rn <= take[gc_bin + 1]', views.TILES, views.ZONES, GENOME, BINS, MATCHING)
def g07_matching_loci(spark, sf_dir):
    """Background tiles with the GC histogram of windows around all zones, none of them touched."""
    tiles = views.tiles(spark, sf_dir).select("chrom", F.col("tile_start").alias("start"), (F.col("tile_start") + views.TILE).alias("end"), "seq")
    zones = views.zones(spark, sf_dir).withColumn("locus_idx", F.concat_ws(":", "chrom", "start"))
    around = loci.extract_loci(zones, views.tiles(spark, sf_dir), views.sizes(spark, sf_dir), tile=views.TILE, in_window=views.TILE)
    targets = checkpointed(zones.join(around.select("locus_idx", "seq"), "locus_idx").select("chrom", "start", "end", "seq"))
    return match.matching_loci(targets, tiles, width=0.04)


@query(
    """SELECT round(max(abs(ca / ta - cb / tb)), 9) AS ks FROM (SELECT sum(a) OVER (ORDER BY v) AS ca, sum(b) OVER (ORDER BY v) AS cb, sum(a) OVER () AS ta, sum(b) OVER () AS tb FROM
    (SELECT gc AS v, sum(CASE WHEN chrom = 'chr1' THEN 1.0 ELSE 0 END)::DOUBLE AS a, sum(CASE WHEN chrom <> 'chr1' THEN 1.0 ELSE 0 END)::DOUBLE AS b FROM bins GROUP BY 1))""",
    views.TILES,
    BINS,
)
def g08_ks_statistic(spark, sf_dir):
    """How far the GC content of one chromosome is from that of the others."""
    gc = match.gc_profile(views.tiles(spark, sf_dir), 1.0, 0.04)
    return match.ks_statistic(gc.where("chrom = 'chr1'"), gc.where("chrom <> 'chr1'"), "gc").select(F.round("ks", 9).alias("ks"))


@query("SELECT example_idx, pos, value FROM attr WHERE pos >= 10 AND pos < 40 AND abs(value) > 50", views.ATTR)
def x01_logo_letters(spark, sf_dir):
    """Letters of a logo that are in view and high enough."""
    return plotdata.logo_letters(views.attr(spark, sf_dir), 10, 40, 50.0)


@query("""SELECT *, CAST(row_number() OVER (PARTITION BY example_idx ORDER BY "start", "end", annotation_idx) AS INT) AS rank FROM annotations WHERE "start" > 10 AND "end" < 50""", views.ANNOTATIONS)
def x01_annotations_in_view(spark, sf_dir):
    """Annotations in view, by start."""
    return plotdata.annotations_in_view(views.annotations(spark, sf_dir), 10, 50)


@query("SELECT example_idx, CAST(pos // 4 AS INT) AS pos, CAST(arg_max(pos % 4, (abs(value), -(pos % 4))) AS INT) AS char_idx, sum(value) AS total FROM attr GROUP BY 1, 2", views.ATTR)
def x03_strongest_letter(spark, sf_dir):
    """The strongest letter of each position, tracks read as four letters a position."""
    rows = views.attr(spark, sf_dir).select("example_idx", F.floor(F.col("pos") / 4).cast("int").alias("pos"), (F.col("pos") % 4).alias("char_idx"), "value")
    return plotdata.strongest_letter(rows)


@query(
    """SELECT example_idx, annotation_idx, "start", "end", track FROM (
    WITH RECURSIVE w AS (
      SELECT example_idx, r, annotation_idx, "start", "end", ["end"] AS ends, 0 AS track FROM rows_ WHERE r = 1
      UNION ALL
      SELECT x.example_idx, x.r, x.annotation_idx, x."start", x."end", CASE WHEN spot > len(ends) THEN list_append(ends, x."end") ELSE list_transform(ends, lambda e, i: CASE WHEN i = spot THEN x."end" ELSE e END) END, CAST(spot - 1 AS INT)
      FROM w JOIN rows_ x ON x.example_idx = w.example_idx AND x.r = w.r + 1, LATERAL (SELECT coalesce(list_position(list_transform(ends, lambda e: e <= x."start"), true), len(ends) + 1) AS spot) l)
    SELECT * FROM w)""",
    views.ANNOTATIONS,
    ROWS,
)
def x06_label_tracks(spark, sf_dir):
    """Tracks for labels so that none overlap."""
    return plotdata.label_tracks(views.annotations(spark, sf_dir))


@query(
    """SELECT motif_idx, pos, char_idx, round(p * b, 6) + 0.0 AS height FROM (SELECT *, sum(p * log2(p + 1e-7) + 0.5::DOUBLE) OVER (PARTITION BY motif_idx, pos) AS b FROM (SELECT motif_idx, pos, char_idx, CASE WHEN s = 0 THEN 0 ELSE w / s END AS p
    FROM (SELECT *, sum(w) OVER (PARTITION BY motif_idx, pos) AS s FROM motifs)))""",
    views.ATTR,
    MOTIFS,
)
def x05_motif_heights(spark, sf_dir):
    """Heights of letters in motif logos."""
    motifs = motif_columns(spark, sf_dir)
    total = F.aggregate("probs", F.lit(0.0), lambda a, w: a + w)
    shares = motifs.withColumn("total", total).withColumn("probs", F.transform("probs", lambda w: F.when(F.col("total") == 0, F.lit(0.0)).otherwise(w / F.col("total"))))
    return plotdata.motif_heights(shares).select("motif_idx", "pos", "char_idx", (F.round("height", 6) + F.lit(0.0)).alias("height"))


@query("SELECT example_idx, pos, value * k AS value, CASE k WHEN 1 THEN 'plain' ELSE 'double' END AS model FROM attr, (VALUES (1), (2)) AS t(k)", views.ATTR)
def x04_model_tracks(spark, sf_dir):
    """Tracks of two models in one table."""
    attr = views.attr(spark, sf_dir)
    return plotdata.model_tracks({"plain": attr, "double": attr.withColumn("value", F.col("value") * 2)})
