"""Queries over functions, vectors, the face graph, changes and events, each
with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..fixtures import EMBEDDER, Catalog, sql
from ..functions import numeric as N
from ..functions import text, vectors
from ..operators import graph as G
from ..operators import layout
from ..operators import listing as L
from ..operators import mutations as M
from ..operators import vector as V
from ..streaming import events as T
from . import search
from .relational import ACTIONS, CONSTRAINTS, EDGES, FOLD, LISTING, NOW, REPORTS, SUGGESTED, TAKEN, _BEST, _TAGGED, _constraints, _edges, _listing, _reports, _suggested, _thumbed, THUMBED

TAU = 0.30
EV = "fs_events"
DOT = "list_dot_product({}::DOUBLE[], {}::DOUBLE[])"


def _r(c, n=6):
    return F.round(c, n)


def _vec(c: Catalog, k: int) -> list[float]:
    return list(c.raw("embeddings").where(F.col("vec_id") == k).first()["embedding"])


def _index(c: Catalog):
    return V.indexed(c.face_vectors)


UNIT = "unit AS (SELECT id, subject_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(" + DOT.format("embedding", "embedding") + ")) AS u FROM face_vectors)"
HITS = UNIT + ", hits AS (SELECT a.id, " + DOT.format("a.u", "b.u") + " AS score, row_number() OVER (ORDER BY " + DOT.format("a.u", "b.u") + " DESC, a.id) AS rank FROM unit a, unit b WHERE b.id = 7 QUALIFY rank <= 50)"
CUT = HITS + ", gaps AS (SELECT *, score - lead(score) OVER (ORDER BY rank) AS gap FROM hits), cut AS (SELECT * FROM hits WHERE rank <= coalesce((SELECT rank FROM gaps WHERE gap >= 0.05 ORDER BY gap DESC, rank LIMIT 1), 1000))"
SIMS = "sims AS (SELECT a.id, b.id AS other, 1 - (" + DOT.format("a.embedding", "a.embedding") + " + " + DOT.format("b.embedding", "b.embedding") + " - 2 * " + DOT.format("a.embedding", "b.embedding") + ") / 2 AS score, a.subject_id AS mine, b.subject_id AS theirs FROM face_vectors a, face_vectors b WHERE a.id <> b.id)"
KNN = SIMS + """, sizes AS (SELECT subject_id, count(*) AS size FROM face_vectors WHERE subject_id IS NOT NULL GROUP BY 1),
  near AS (SELECT s.*, row_number() OVER (PARTITION BY s.id ORDER BY score DESC, other) AS place, 5 + coalesce(size, 0) AS asked FROM sims s LEFT JOIN sizes ON mine = subject_id QUALIFY place <= asked),
  knn AS (SELECT id, other, score FROM near WHERE mine IS NULL OR theirs IS NULL OR mine <> theirs QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, other) <= 5)"""
MUTUAL = KNN + f", mutual AS (SELECT x.id AS face_a, x.other AS face_b, x.score AS weight FROM knn x JOIN knn y ON x.id = y.other AND x.other = y.id WHERE x.id < x.other AND x.score >= {TAU})"
REACH = """, nodes AS (SELECT id FROM face_vectors), both_ AS (SELECT face_a AS a, face_b AS b FROM {e} UNION SELECT face_b, face_a FROM {e}),
  reach AS (SELECT id, id AS spot FROM nodes UNION SELECT r.id, b.b FROM reach r JOIN both_ b ON r.spot = b.a), comp AS (SELECT id, min(spot) AS component FROM reach GROUP BY 1)"""
RECURSIVE = "WITH RECURSIVE"


def _knn(c: Catalog):
    return G.subject_knn(c.face_vectors)


def _mutual(c: Catalog):
    return G.mutual_edges(_knn(c), TAU)


def _recursive(q: str) -> str:
    return RECURSIVE + q.removeprefix("WITH")


def _clusters(c: Catalog):
    v = c.face_vectors.select("id")
    return G.constrained_components(v, _mutual(c), _constraints(c).where("face_a <= (%d)" % 10**9))


def _dismissed(c: Catalog):
    return c.subjects.sparkSession.createDataFrame([(0, 1), (5, 2), (7, 9)], "subject_id_a long, subject_id_b long")


def _labels(c: Catalog):
    return c.spark.createDataFrame([(k, f"S{k}" if k % 4 else None) for k in range(10)], "id long, name string")


LABELS = "labels_ AS (SELECT range AS id, CASE WHEN range % 4 <> 0 THEN 'S' || range END AS name FROM range(10))"
ALLOWED = """allowed AS (SELECT * FROM mutual e WHERE NOT EXISTS (SELECT 1 FROM constraints c WHERE kind = 'cannot_link' AND least(c.face_a, c.face_b) = e.face_a AND greatest(c.face_a, c.face_b) = e.face_b)),
  met AS (SELECT least(a.subject_id, b.subject_id) AS subject_id_a, greatest(a.subject_id, b.subject_id) AS subject_id_b, max(weight) AS score FROM allowed JOIN face_vectors a ON a.id = face_a JOIN face_vectors b ON b.id = face_b WHERE a.subject_id <> b.subject_id GROUP BY 1, 2),
  gone AS (SELECT DISTINCT least(a.subject_id, b.subject_id) AS lo, greatest(a.subject_id, b.subject_id) AS hi FROM constraints JOIN face_vectors a ON a.id = face_a JOIN face_vectors b ON b.id = face_b WHERE kind = 'cannot_link' AND source = 'dismiss')"""


def _boxes(c: Catalog):
    f = c.faces.select("image_id", "id", "bbox_x", "bbox_y", "bbox_w", "bbox_h")
    g = f.select("image_id", F.col("id").alias("other"), *(F.col(f"bbox_{k}").alias(f"o{k}") for k in "xywh"))
    return f.join(g, "image_id").where("id < other").select("id", "other", _r(N.iou(N.box(), tuple(F.col(f"o{k}") for k in "xywh"))).alias("iou"))


def _detections(c: Catalog):
    """Detections near the faces of all images, shifted a little, some missing."""
    f = c.faces
    n = F.row_number().over(Window.partitionBy("image_id").orderBy("id")) - 1
    return f.select("image_id", n.cast("int").alias("det_idx"), (F.col("bbox_x") + 0.01).alias("bbox_x"), "bbox_y", "bbox_w", "bbox_h", "id").where("id % 4 <> 1").drop("id")


def _people(c: Catalog) -> dict:
    return {"subjects": c.subjects, "faces": c.faces, "subject_tags": c.subject_tags, "constraints": _constraints(c), "merge_suggestions": _suggested(c), "dismissed_pairs": c.spark.createDataFrame([(1, 2, 0)], "subject_id_a long, subject_id_b long, dismissed_at long")}


PEOPLE = "few AS (SELECT * FROM faces)"
SOME = "SELECT id, image_id FROM faces"


def _folder_tables(c: Catalog) -> dict:
    v = c.face_vectors.select((F.col("id") * 1000 + 1).alias("id"))
    return {"folders": c.folders, "images": c.images, "queue": c.queue, "faces": c.faces, "face_vectors": v, "subjects": _thumbed(c)}


def _samples(c: Catalog):
    """A user's events an hour: t in seconds, n, pending (0 at times)."""
    t = (F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600) * 3600).cast("long")
    e = c.raw("events").groupBy(F.col("user_id"), t.alias("t")).agg(F.count("*").alias("n"))
    return e.withColumn("pending", (F.col("t") / 3600).cast("long") % 5)


SAMPLES = "samples AS (SELECT user_id, (epoch(ts)::BIGINT // 3600) * 3600 AS t, count(*) AS n FROM (SELECT user_id, date_trunc('second', ts) AS ts FROM events) GROUP BY 1, 2), ticks AS (SELECT *, (t // 3600) % 5 AS pending FROM samples)"
RATE = "CASE WHEN count(*) OVER w >= 2 THEN sum(n) OVER w / greatest((t - min(t) OVER w)::DOUBLE, 1e-3) ELSE 0 END"
BURSTS = f"""marked AS (SELECT *, sum(CASE WHEN epoch_us(ts) - epoch_us(prev) > 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY ts, event_id) AS burst FROM (SELECT *, lag(ts) OVER (PARTITION BY path ORDER BY ts, event_id) AS prev FROM fs_events)),
  listed AS (SELECT path, burst, min(ts) AS first, max(ts) AS last, count(*) AS n, list(kind ORDER BY ts, event_id) AS kinds FROM marked GROUP BY 1, 2),
  folded AS (SELECT *, list_reduce(kinds, lambda a, k: CASE {" ".join(f"WHEN a = '{a}' AND k = '{k}' THEN '{z}'" for (a, k), z in T.AFTER.items())} ELSE k END, '') AS kind FROM listed)"""


def queries() -> dict:
    return {
        # ranking
        "w6_gaps": (lambda c: V.top_k(_index(c), _vec(c, 7)).withColumn("gap", _r(F.col("score") - F.lead("score").over(Window.orderBy(F.col("score").desc(), "id")))).select("id", "gap"), sql(HITS + ">> SELECT id, round(score - lead(score) OVER (ORDER BY rank), 6) AS gap FROM hits", "face_vectors")),
        "w8_markers": (lambda c: layout.markers(layout.days(c.images)).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "place"), sql(f"days AS (SELECT DISTINCT make_timestamp({TAKEN} * 1000000)::DATE AS day FROM images), placed AS (SELECT day, row_number() OVER (ORDER BY day DESC) AS place, count(*) OVER () AS of FROM days) >> SELECT strftime(day, '%Y-%m-%d') AS day, place::INT AS place FROM placed WHERE place = 1 OR place = of OR day(day) = 1", "images")),
        "w9_scrub": (lambda c: layout.at_percent(layout.days(c.images), 0.37).select(F.date_format("day", "yyyy-MM-dd").alias("day")), sql(f"days AS (SELECT DISTINCT make_timestamp({TAKEN} * 1000000)::DATE AS day FROM images), placed AS (SELECT day, row_number() OVER (ORDER BY day DESC) - 1 AS place, count(*) OVER () AS of FROM days) >> SELECT strftime(day, '%Y-%m-%d') AS day FROM placed WHERE place = greatest(0, least(floor(0.37 * of), of - 1))", "images")),
        "w10_neighbours": (lambda c: layout.neighbours(c.images.where("folder_id = 3").select("id", L.taken().alias("taken")), F.col("taken").desc(), F.col("id").desc()).select("id", "previous", "next"), sql(f"rows_ AS (SELECT id, {TAKEN} AS taken FROM images WHERE folder_id = 3) >> SELECT id, coalesce(lag(id) OVER w, last_value(id) OVER (ORDER BY taken DESC, id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS previous, coalesce(lead(id) OVER w, first_value(id) OVER w) AS next FROM rows_ WINDOW w AS (ORDER BY taken DESC, id DESC)", "images")),
        "w11_packed_rows": (lambda c: layout.justified(c.images.where("folder_id = 3").select(F.to_date(F.timestamp_seconds(L.taken())).cast("string").alias("day"), "id", L.taken().alias("taken")), "day", 1000, 200), None),
        "w12_flattened": (lambda c: layout.flattened(c.images.where("folder_id = 3").select(F.to_date(F.timestamp_seconds(L.taken())).cast("string").alias("day"), "id", L.taken().alias("taken")), "day", ["1995-01-01"], 1000, 200), None),
        "u2_first_places": (lambda c: search.first_places(c.faces.where("subject_id = 1").groupBy(F.col("image_id").alias("id")).agg(F.min("id").alias("pos")), c.faces.where("subject_id = 2").groupBy(F.col("image_id").alias("id")).agg(F.min("id").alias("pos"))), sql("legs AS (SELECT image_id AS id, subject_id - 1 AS leg, min(id) AS pos FROM faces WHERE subject_id IN (1, 2) GROUP BY image_id, subject_id) >> SELECT id, leg::INT AS leg, pos FROM legs QUALIFY row_number() OVER (PARTITION BY id ORDER BY leg) = 1", "faces")),
        "u6_tag_union": (lambda c: M.merge_subjects(_people(c), 4, 1, NOW)["subject_tags"].select("subject_id", "tag_id"), sql("SELECT DISTINCT CASE WHEN subject_id = 1 THEN 4 ELSE subject_id END AS subject_id, tag_id FROM subject_tags", "subject_tags")),
        "u7_affected": (lambda c: _affected(c), sql(SIMS + ", new_ AS (SELECT id FROM face_vectors WHERE id < 10), near AS (SELECT s.other FROM sims s JOIN new_ USING (id) QUALIFY row_number() OVER (PARTITION BY s.id ORDER BY score DESC, other) <= 6) >> SELECT id FROM new_ UNION SELECT other FROM near", "face_vectors")),
        # scalar functions
        "f1_folded": (lambda c: c.raw("documents").select("doc_id", F.md5(text.folded(F.col("text"))).alias("folded")), f"SELECT doc_id, md5({FOLD.format("regexp_replace(text, '^\\s+|\\s+$', '', 'g')")}) AS folded FROM documents"),
        "f2_pattern": (lambda c: c.raw("part").select("p_partkey", text.like_pattern_column(F.concat("p_name", F.lit("_"), "p_brand", F.lit(" 5%"))).alias("pattern")), "SELECT p_partkey, '%' || replace(regexp_replace(lower(p_name || '_' || p_brand || ' 5%'), '([\\\\%_])', '\\\\\\1', 'g'), ' ', '%') || '%' AS pattern FROM part"),
        "f3_unit": (lambda c: _index(c).select("id", _r(F.get("unit", F.lit(0))).alias("x0"), _r(vectors.norm(F.col("unit"))).alias("norm")), sql(UNIT + ">> SELECT id, round(u[1], 6) AS x0, round(sqrt(" + DOT.format("u", "u") + "), 6) AS norm FROM unit", "face_vectors")),
        "f4_dot": (lambda c: _pairwise(c).select("a", "b", _r(vectors.dot(F.col("x"), F.col("y"))).alias("dot")), sql("SELECT a.id AS a, b.id AS b, round(" + DOT.format("a.embedding", "b.embedding") + ", 6) AS dot FROM face_vectors a JOIN face_vectors b ON b.id = a.id + 1", "face_vectors")),
        "f5_cosine": (lambda c: _pairwise(c).select("a", "b", _r(N.l2_to_cosine(vectors.l2(F.col("x"), F.col("y")))).alias("cosine")), sql("SELECT a.id AS a, b.id AS b, round(1 - pow(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 2) / 2, 6) AS cosine FROM face_vectors a JOIN face_vectors b ON b.id = a.id + 1", "face_vectors")),
        "f6_iou": (lambda c: _boxes(c), sql("pairs AS (SELECT f.id, g.id AS other, f.bbox_w * f.bbox_h AS fa, g.bbox_w * g.bbox_h AS ga, least(f.bbox_x + f.bbox_w, g.bbox_x + g.bbox_w) - greatest(f.bbox_x, g.bbox_x) AS w, least(f.bbox_y + f.bbox_h, g.bbox_y + g.bbox_h) - greatest(f.bbox_y, g.bbox_y) AS h FROM faces f JOIN faces g USING (image_id) WHERE f.id < g.id) >> SELECT id, other, CASE WHEN w <= 0 OR h <= 0 THEN 0 ELSE round(w * h / (fa + ga - w * h), 6) END AS iou FROM pairs", "faces")),
        "f7_frontality": (lambda c: c.raw("part").select("p_partkey", _r(N.frontality(_marks())).alias("front")), "marks AS (SELECT p_partkey, 0.3 AS lx, 0.4 AS ly, 0.3 + p_size / 100.0 AS rx, 0.4 + (p_partkey % 7) / 50.0 AS ry, 0.3 + (p_partkey % 11) / 40.0 AS nx FROM part), d AS (SELECT *, greatest(sqrt(pow(rx - lx, 2) + pow(ry - ly, 2)), 1e-6) AS apart FROM marks) SELECT p_partkey, round(0.5 * least(greatest(abs((rx - lx) / apart), 0), 1) + 0.5 * least(greatest(1 - abs(nx - (lx + rx) / 2) / (apart / 2), 0), 1), 6) AS front FROM d".join(["WITH ", ""])),
        "f8_quality": (lambda c: c.faces.select("id", _r(N.quality(F.col("det_score"), F.col("bbox_x"), N.sharpness(F.col("bbox_w") * 4000))).alias("quality")), sql("SELECT id, round(least(greatest(0.40 * least(det_score, 1) + 0.35 * least(bbox_x, 1) + 0.25 * (bbox_w * 4000 / (bbox_w * 4000 + 500)), 0), 1), 6) AS quality FROM faces", "faces")),
        "f9_sharpness": (lambda c: c.raw("part").select("p_partkey", _r(N.sharpness(F.col("p_retailprice"))).alias("sharp")), "SELECT p_partkey, round(p_retailprice / (p_retailprice + 500), 6) AS sharp FROM part"),
        "f10_retry_wait": (lambda c: c.queue.select("id", N.retry_wait(F.col("attempts")).alias("wait")), sql("SELECT id, CASE WHEN attempts + 1 < 7 THEN least(5 * pow(2, least(attempts, 10)), 120)::BIGINT END AS wait FROM queue", "queue")),
        "f11_low_high": (lambda c: c.raw("orders").select("o_orderkey", *(x.alias(n) for x, n in zip(N.low_high(F.col("o_orderkey"), F.col("o_custkey")), ("lo", "hi"), strict=True))), "SELECT o_orderkey, least(o_orderkey, o_custkey) AS lo, greatest(o_orderkey, o_custkey) AS hi FROM orders"),
        "f13_eta": (lambda c: c.queue.select("id", N.eta_seconds(F.col("image_id"), F.col("attempts") / 2).alias("eta"), N.eta_label(N.eta_seconds(F.col("image_id"), F.col("attempts") / 2)).alias("label")), sql("e AS (SELECT id, CASE WHEN attempts > 0 THEN floor(image_id / (attempts / 2) + 0.5)::BIGINT ELSE 0 END AS eta FROM queue), m AS (SELECT *, floor(eta / 60 + 0.5)::BIGINT AS mins FROM e) >> SELECT id, eta, CASE WHEN eta <= 0 THEN '' WHEN eta < 60 THEN '~' || eta || 's left' WHEN mins < 60 THEN '~' || mins || ' min left' WHEN mins % 60 = 0 THEN '~' || mins // 60 || 'h left' ELSE '~' || mins // 60 || 'h ' || mins % 60 || 'm left' END AS label FROM m", "queue")),
        "f14_day_label": (lambda c: c.raw("orders").select("o_orderkey", N.day_label(F.col("o_orderdate").cast("date"), F.lit("1995-08-02").cast("date")).alias("label")), "SELECT o_orderkey, CASE WHEN d = 0 THEN 'Today' WHEN d = 1 THEN 'Yesterday' WHEN d BETWEEN 2 AND 6 THEN 'This Week' WHEN d BETWEEN 7 AND 13 THEN 'Last Week' ELSE strftime(o_orderdate, '%B %-d, %Y') END AS label FROM (SELECT *, datediff('day', o_orderdate::DATE, DATE '1995-08-02') AS d FROM orders)"),
        "f15_crop": (lambda c: c.faces.select("id", N.crop_square(F.col("bbox_w"), F.col("bbox_h"), F.col("bbox_x"), F.col("bbox_y"), F.lit(1600), F.lit(1200)).alias("s")).select("id", "s.left", "s.top", "s.side"), sql("s AS (SELECT *, greatest(least(greatest(bbox_w * 1600, bbox_h * 1200) * 1.8, 1200), 1) AS side FROM faces) >> SELECT id, floor(greatest(0, least((bbox_x + bbox_w / 2) * 1600 - side / 2, 1600 - side)) + 0.5)::BIGINT AS left, floor(greatest(0, least((bbox_y + bbox_h / 2) * 1200 - side / 2, 1200 - side)) + 0.5)::BIGINT AS top, floor(side + 0.5)::BIGINT AS side FROM s", "faces")),
        "f16_fit_within": (lambda c: c.raw("part").select("p_partkey", N.fit_within(F.col("p_partkey") * 3 + 10, F.col("p_size") * 40, 800).alias("s")).select("p_partkey", "s.width", "s.height"), "WITH s AS (SELECT p_partkey, p_partkey * 3 + 10 AS w, p_size * 40 AS h, least(1.0, 800.0::DOUBLE / greatest(p_partkey * 3 + 10, p_size * 40)) AS f FROM part) SELECT p_partkey, greatest(1, floor(w * f + 0.5)::BIGINT) AS width, greatest(1, floor(h * f + 0.5)::BIGINT) AS height FROM s"),
        "f17_extension": (lambda c: c.raw("pages").select("page_id", text.is_image(F.concat("url", F.lit(".JPG"))).alias("image"), text.basename(F.replace(F.col("url"), F.lit("/"), F.lit("\\"))).alias("base")), "SELECT page_id, true AS image, list_extract(string_split(url, '/'), -1) AS base FROM pages"),
        "f18_cache_key": (lambda c: c.raw("documents").select("doc_id", text.cache_key(F.col("text")).alias("key")), "SELECT doc_id, sha256(text) AS key FROM documents"),
        "f19_content_hash": (lambda c: c.raw("pages").select("page_id", text.content_hash(F.col("html").cast("binary")).alias("hash")), "SELECT page_id, sha256(html) AS hash FROM pages"),
        "f21_taken": (lambda c: c.images.select("id", L.taken().alias("taken")), sql(f"SELECT id, {TAKEN} AS taken FROM images", "images")),
        "f22_workers": (lambda c: c.queue.select("id", N.preview_workers(F.col("attempts"), F.col("id") % 10, 8).alias("workers")), sql("SELECT id, CASE WHEN attempts > 0 OR id % 10 < 5 THEN 8 ELSE 2 END AS workers FROM queue", "queue")),
        "f23_merge_target": (lambda c: _targets(c), sql(SUGGESTED + "SELECT p.id, CASE WHEN a.name IS NOT NULL AND b.name IS NULL THEN a.id WHEN b.name IS NOT NULL AND a.name IS NULL THEN b.id ELSE least(a.id, b.id) END AS target FROM pairs p JOIN subjects a ON a.id = subject_id_a JOIN subjects b ON b.id = subject_id_b", "subjects")),
        "f24_same_name": (lambda c: c.subjects.select("id", text.same_name(F.col("name"), F.concat(F.lit(" SUPPLIER#0000000"), F.lpad(F.col("id").cast("string"), 2, "0"))).alias("same")), sql("SELECT id, coalesce(lower(trim(name)) = 'supplier#0000000' || lpad(id::VARCHAR, 2, '0'), false) AS same FROM subjects", "subjects")),
        "f25_description": (lambda c: _described(c), sql(REPORTS + ">> SELECT report_id, string_agg(coalesce(t.name, 'Unknown'), ', ' ORDER BY pos) AS description FROM report_tags r LEFT JOIN tags t ON t.id = r.tag_id GROUP BY 1", "folders", "tags")),
        "f26_preset": (lambda c: c.queue.select("id", F.coalesce(F.create_map(F.lit("semantic"), F.lit("base"))[F.col("pipeline")], F.lit("default")).alias("preset")), sql("SELECT id, CASE pipeline WHEN 'semantic' THEN 'base' ELSE 'default' END AS preset FROM queue", "queue")),
        # vectors
        "v1_upsert": (lambda c: V.upserted(_index(c), _index(c).where("id % 10 = 0").select("id", F.transform("unit", lambda x: -x).alias("unit"))).select("id", _r(F.get("unit", F.lit(0))).alias("x0")), sql(UNIT + ">> SELECT id, round(CASE WHEN id % 10 = 0 THEN -u[1] ELSE u[1] END, 6) AS x0 FROM unit", "face_vectors")),
        "v2_remove": (lambda c: V.removed(_index(c), c.face_vectors.where("id % 10 = 0")).agg(F.count("*").alias("live"), F.lit(V.wants_compaction(500, 51)).alias("compact")), sql("SELECT count(*) AS live, true AS compact FROM face_vectors WHERE id % 10 <> 0", "face_vectors")),
        "v3_top_k": (lambda c: L.ranked(V.top_k(_index(c), _vec(c, 7), 50), F.col("score").desc(), F.col("id")).select("id", _r(F.col("score")).alias("score"), "rank"), sql(HITS + ">> SELECT id, round(score, 6) AS score, rank::INT AS rank FROM hits", "face_vectors")),
        "v4_elbow": (lambda c: V.elbow(V.top_k(_index(c), _vec(c, 7))).select("id", _r(F.col("score")).alias("score"), "rank"), sql(CUT + ">> SELECT id, round(score, 6) AS score, rank::INT AS rank FROM cut", "face_vectors")),
        "v5_hydrated": (lambda c: V.hydrated(L.ranked(V.top_k(_index(c), _vec(c, 7)), F.col("score").desc(), F.col("id")), c.images).select("id", "path", "rank"), sql(HITS + ">> SELECT h.id, path, rank::INT AS rank FROM hits h JOIN images i ON i.id = h.id AND deleted_at IS NULL", "face_vectors", "images")),
        "v6_rebuilt": (lambda c: V.rebuilt(c.images.join(c.face_vectors.select("id", "embedding"), "id"), 64).select("id"), sql("SELECT i.id FROM images i JOIN face_vectors v ON i.id = v.id WHERE deleted_at IS NULL AND semantic_analysis_done AND len(embedding) = 64", "images", "face_vectors")),
        "v7_similar_faithful": (lambda c: V.similar_to(_index(c), c.images, 7, _vec(c, 7)).select("id", "rank"), sql(CUT + ">> SELECT c.id, rank::INT AS rank FROM cut c JOIN images i ON i.id = c.id AND deleted_at IS NULL WHERE c.id <> 7", "face_vectors", "images")),
        "v7_similar_self_first": (lambda c: V.similar_to(_index(c), c.images, 7, _vec(c, 7), True).select("id", _r(F.col("score")).alias("score")), sql(UNIT + ", hits AS (SELECT a.id, " + DOT.format("a.u", "b.u") + " AS score, row_number() OVER (ORDER BY " + DOT.format("a.u", "b.u") + " DESC, a.id) AS rank FROM unit a, unit b WHERE b.id = 7 AND a.id <> 7 QUALIFY rank <= 50), gaps AS (SELECT *, score - lead(score) OVER (ORDER BY rank) AS gap FROM hits), cut AS (SELECT * FROM hits WHERE rank <= coalesce((SELECT rank FROM gaps WHERE gap >= 0.05 ORDER BY gap DESC, rank LIMIT 1), 1000)) >> SELECT c.id, round(score, 6) AS score FROM cut c JOIN images i ON i.id = c.id AND deleted_at IS NULL", "face_vectors", "images")),
        "v9_text_search": (lambda c: search.text_search(c.images, c.faces, c.subjects, c.subject_tags, c.tags, _index(c), "brand 1", _vec(c, 7)).select("id", "leg", _r(F.col("score")).alias("score")), sql(_TAGGED + ", " + CUT + ", taglist AS (SELECT DISTINCT image_id AS id FROM faces JOIN tagged USING (subject_id) JOIN images i ON i.id = image_id WHERE deleted_at IS NULL), names AS (SELECT DISTINCT image_id AS id FROM faces JOIN (SELECT subject_id FROM tagged ORDER BY 1 LIMIT 20) USING (subject_id) JOIN images i ON i.id = image_id WHERE deleted_at IS NULL), vec AS (SELECT c.id, score FROM cut c JOIN images i ON i.id = c.id AND deleted_at IS NULL) >> SELECT id, 0 AS leg, 1.0::DOUBLE AS score FROM taglist UNION ALL SELECT id, 1, 1 FROM names WHERE id NOT IN (SELECT id FROM taglist) UNION ALL SELECT id, 2, round(score, 6) FROM vec WHERE id NOT IN (SELECT id FROM taglist) AND id NOT IN (SELECT id FROM names)", "faces", "images", "subject_tags", "face_vectors")),
        "v10_knn": (lambda c: V.knn_of(c.face_vectors, 7, _vec(c, 7), 5).select("id", _r(F.col("distance")).alias("distance")), sql("SELECT a.id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance FROM face_vectors a, face_vectors b WHERE b.id = 7 AND a.id <> 7 ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), a.id LIMIT 5", "face_vectors")),
        "v11_knn_cosine": (lambda c: V.knn_of(c.face_vectors, 7, _vec(c, 7), 5).select("id", _r(N.l2_to_cosine(F.col("distance"))).alias("cosine")), sql("SELECT a.id, round(1 - pow(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 2) / 2, 6) AS cosine FROM face_vectors a, face_vectors b WHERE b.id = 7 AND a.id <> 7 ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), a.id LIMIT 5", "face_vectors")),
        # graph
        "g1_subject_knn": (lambda c: _knn(c).select("id", "other", _r(F.col("score")).alias("score")), sql(KNN + ">> SELECT id, other, round(score, 6) AS score FROM knn", "face_vectors")),
        "g2_mutual_edges": (lambda c: _mutual(c).select("face_a", "face_b", _r(F.col("weight")).alias("weight")), sql(MUTUAL + ">> SELECT face_a, face_b, round(weight, 6) AS weight FROM mutual", "face_vectors")),
        "g3_constrained": (lambda c: _clusters(c), None),
        "g4_components": (lambda c: G.components(c.face_vectors.select("id"), _edges(c).select(F.col("face_a").alias("a"), F.col("face_b").alias("b"))), _recursive(sql(EDGES + ", linked_ AS (SELECT * FROM edges)" + REACH.format(e="linked_") + ">> SELECT id, component FROM comp WHERE id < 500 OR id IN (SELECT id FROM nodes)", "face_vectors"))),
        "a11_component_sizes": (lambda c: G.components(c.face_vectors.select("id"), _edges(c).select(F.col("face_a").alias("a"), F.col("face_b").alias("b"))).join(c.face_vectors.select("id", "subject_id"), "id").groupBy("component").agg(F.count("*").alias("size"), F.countDistinct("subject_id").alias("subjects")), _recursive(sql(EDGES + ", linked_ AS (SELECT * FROM edges)" + REACH.format(e="linked_") + ">> SELECT component, count(*) AS size, count(DISTINCT subject_id) AS subjects FROM comp JOIN face_vectors USING (id) GROUP BY 1", "face_vectors"))),
        "g5_label_actions": (lambda c: G.label_actions(_chains(c), c.face_vectors, _labels(c)), _recursive(sql(EDGES + ", linked_ AS (SELECT * FROM edges)" + REACH.format(e="linked_") + ", " + LABELS + ", met AS (SELECT component AS cluster, count(*) AS size, count(*) FILTER (subject_id IS NULL) AS unlabeled, count(DISTINCT subject_id) AS subjects, min(subject_id) AS one, coalesce(bool_or(name IS NOT NULL) FILTER (subject_id IS NOT NULL), false) AS named FROM comp JOIN face_vectors f USING (id) LEFT JOIN labels_ l ON l.id = f.subject_id GROUP BY 1) >> SELECT cluster, size, unlabeled, subjects, CASE WHEN subjects = 1 THEN one END AS subject_id, CASE WHEN subjects = 0 THEN CASE WHEN size >= 2 THEN 'new_subject' ELSE 'noise' END WHEN subjects = 1 THEN CASE WHEN unlabeled > 0 THEN 'assign_all' ELSE 'none' END WHEN named THEN 'suggest_merge' ELSE 'none' END AS action FROM met", "face_vectors"))),
        "g6_relabel": (lambda c: _relabelled(c), None),
        "g7_reconcile": (lambda c: G.reconciled(_detections(c), c.faces), None),
        "g8_incremental": (lambda c: G.incremental_edges(_edges(c).where("face_a >= 10"), c.face_vectors, c.face_vectors.where("id < 10"), tau=TAU), None),
        "g10_suggestions": (lambda c: G.merge_suggestions(_mutual(c), c.face_vectors, _labels(c), _constraints(c), _dismissed(c)).select("subject_id_a", "subject_id_b", _r(F.col("score")).alias("score")), sql(MUTUAL + ", " + CONSTRAINTS + ", " + ALLOWED + ", " + LABELS + ">> SELECT m.subject_id_a, m.subject_id_b, round(score, 6) AS score FROM met m JOIN labels_ a ON a.id = m.subject_id_a JOIN labels_ b ON b.id = m.subject_id_b WHERE (a.name IS NOT NULL OR b.name IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.lo = m.subject_id_a AND g.hi = m.subject_id_b) AND (m.subject_id_a, m.subject_id_b) NOT IN ((0, 1), (2, 5), (7, 9))", "face_vectors")),
        "a6_pair_scores": (lambda c: _pair_scores(c), sql(MUTUAL + ">> SELECT least(a.subject_id, b.subject_id) AS lo, greatest(a.subject_id, b.subject_id) AS hi, round(max(weight), 6) AS score FROM mutual JOIN face_vectors a ON a.id = face_a JOIN face_vectors b ON b.id = face_b WHERE a.subject_id <> b.subject_id GROUP BY 1, 2", "face_vectors")),
        "j18_overlaps": (lambda c: _boxes(c).where("iou >= 0.5"), sql("pairs AS (SELECT f.id, g.id AS other, f.bbox_w * f.bbox_h AS fa, g.bbox_w * g.bbox_h AS ga, least(f.bbox_x + f.bbox_w, g.bbox_x + g.bbox_w) - greatest(f.bbox_x, g.bbox_x) AS w, least(f.bbox_y + f.bbox_h, g.bbox_y + g.bbox_h) - greatest(f.bbox_y, g.bbox_y) AS h FROM faces f JOIN faces g USING (image_id) WHERE f.id < g.id) >> SELECT * FROM (SELECT id, other, CASE WHEN w <= 0 OR h <= 0 THEN 0 ELSE round(w * h / (fa + ga - w * h), 6) END AS iou FROM pairs) WHERE iou >= 0.5", "faces")),
        "j20_face_pairs": (lambda c: M.merge_linked(_constraints(c), c.faces_beside(3, 5), 3, 5, 0).where("source = 'merge'").select("face_a", "face_b"), sql(PEOPLE + ">> SELECT least(a.id, b.id) AS face_a, greatest(a.id, b.id) AS face_b FROM few a, few b WHERE a.subject_id = 3 AND b.subject_id = 5", "faces")),
        "g11_merged_subjects": (lambda c: M.merge_subjects(_people(c), 4, 5, NOW)["subjects"].select("id", "name", "thumbnail_face_id"), sql(PEOPLE + ", moved AS (SELECT id, CASE WHEN subject_id = 5 THEN 4 ELSE subject_id END AS subject_id, quality_score, bbox_w * bbox_h AS area FROM few), best AS (SELECT subject_id, id AS face_id FROM moved WHERE subject_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY quality_score DESC NULLS LAST, area DESC, id) = 1) >> SELECT s.id, CASE WHEN s.id = 4 THEN (SELECT name FROM subjects WHERE id = 5) ELSE s.name END AS name, face_id AS thumbnail_face_id FROM subjects s LEFT JOIN best ON subject_id = s.id WHERE s.id <> 5", "faces", "subjects")),
        "g11_merged_suggestions": (lambda c: M.merge_subjects(_people(c), 4, 5, NOW)["merge_suggestions"], sql(SUGGESTED + "SELECT * FROM pairs WHERE subject_id_a NOT IN (4, 5) AND subject_id_b NOT IN (4, 5)", "subjects")),
        "g12_dismissed": (lambda c: M.dismiss(_people(c), 6, 3, NOW)["constraints"].where(F.col("created_at") == NOW).select("face_a", "face_b", "kind", "source"), sql(PEOPLE + ", three AS (SELECT subject_id, id FROM few WHERE subject_id IN (3, 6) QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY id) <= 3) >> SELECT least(a.id, b.id) AS face_a, greatest(a.id, b.id) AS face_b, 'cannot_link' AS kind, 'dismiss' AS source FROM three a, three b WHERE a.subject_id = 3 AND b.subject_id = 6", "faces")),
        "g13_linked": (lambda c: M.linked(_constraints(c), _edges(c).select(F.col("face_b").alias("x"), F.col("face_a").alias("y")), "cannot_link", "removal", 1).groupBy("kind", "source").agg(F.count("*").alias("n")), sql(EDGES + ", " + CONSTRAINTS + ", all_ AS (SELECT face_a, face_b, kind, source FROM constraints UNION ALL SELECT face_a, face_b, 'cannot_link', 'removal' FROM edges) >> SELECT kind, source, count(*) AS n FROM all_ GROUP BY 1, 2", "face_vectors")),
        "g14_assigned": (lambda c: M.assign_face(_people(c)["faces"], _constraints(c), -5, 3, NOW)[1].where(F.col("created_at") == NOW).select("face_a", "face_b", "source"), sql(PEOPLE + ">> SELECT -5::BIGINT AS face_a, id AS face_b, 'manual_assign' AS source FROM few WHERE subject_id = 3", "faces")),
        "g15_unassigned": (lambda c: _unassigned(c), sql(PEOPLE + ", one AS (SELECT min(id) AS id FROM few WHERE subject_id = 3) >> SELECT least(f.id, one.id) AS face_a, greatest(f.id, one.id) AS face_b, 'removal' AS source FROM few f, one WHERE subject_id = 3 AND f.id <> one.id", "faces")),
        "g16_edge_upsert": (lambda c: G.upserted_edges(_edges(c), _edges(c).where("face_a % 3 = 0").select(F.col("face_b").alias("face_a"), F.col("face_a").alias("face_b"), F.lit(0.99).alias("weight"))).select("face_a", "face_b", _r(F.col("weight")).alias("weight")), sql(EDGES + ">> SELECT face_a, face_b, round(CASE WHEN face_a % 3 = 0 THEN 0.99 ELSE weight END, 6)::DOUBLE AS weight FROM edges", "face_vectors")),
        "g17_created": (lambda c: M.create_subject(c.subjects, _people(c)["faces"], 20001, NOW)[0].agg(F.count("*").alias("n"), F.max("id").alias("last")), sql("SELECT count(*) + (SELECT count(*) FROM faces WHERE id = 20001) AS n, max(id) + (SELECT count(*) FROM faces WHERE id = 20001) AS last FROM subjects", "subjects", "faces")),
        # changes
        "d1_tag_inserted": (lambda c: M.create_tag(M.create_tag(c.tags, " Zoo-1 ", NOW), "brand#1", NOW).select("id", "name", "name_normalized"), sql("SELECT id, name, name_normalized FROM tags UNION ALL SELECT (SELECT max(id) FROM tags) + 1, 'Zoo-1', 'zoo-1'", "tags")),
        "d2_folder_deleted": (lambda c: M.delete_folder(3, _folder_tables(c))["subjects"].select("id", "thumbnail_face_id"), sql(THUMBED + ", gone AS (SELECT f.id FROM faces f JOIN images i ON i.id = image_id WHERE folder_id = 3), left_ AS (SELECT DISTINCT subject_id FROM faces JOIN images i ON i.id = image_id WHERE folder_id <> 3 AND subject_id IS NOT NULL) >> SELECT id, CASE WHEN thumbnail_face_id NOT IN (SELECT id FROM gone) THEN thumbnail_face_id END AS thumbnail_face_id FROM thumbed WHERE id IN (SELECT subject_id FROM left_)", "images", "faces", "subjects")),
        "d2_folder_survivors": (lambda c: _counts(M.delete_folder(3, _folder_tables(c)), ("folders", "images", "queue", "faces", "face_vectors")), sql("kept AS (SELECT id FROM images WHERE folder_id <> 3), gone AS (SELECT f.id FROM faces f JOIN images i ON i.id = image_id WHERE folder_id = 3) >> SELECT 'folders' AS name, count(*) AS n FROM folders WHERE id <> 3 UNION ALL SELECT 'images', count(*) FROM kept UNION ALL SELECT 'queue', count(*) FROM queue WHERE image_id IN (SELECT id FROM kept) UNION ALL SELECT 'faces', count(*) FROM faces WHERE image_id IN (SELECT id FROM kept) UNION ALL SELECT 'face_vectors', count(*) FROM face_vectors WHERE id * 1000 + 1 NOT IN (SELECT id FROM gone)", "folders", "images", "queue", "faces", "face_vectors")),
        "d3_soft_deleted": (lambda c: M.undelete(M.soft_delete(c.images, c.images.where("id % 2 = 0"), NOW), c.images.where("id % 6 = 0")).select("id", "deleted_at"), sql(f"SELECT id, CASE WHEN id % 6 = 0 THEN NULL WHEN id % 2 = 0 THEN coalesce(deleted_at, {NOW}) ELSE deleted_at END AS deleted_at FROM images", "images")),
        "d4_applied": (lambda c: M.apply_changes(c.images, M.changes(_listing(c), c.images), NOW).select("id", "file_hash", "hash_status", "file_size", "semantic_analysis_done", "thumbnail_path", "deleted_at"), sql(ACTIONS + f""">> SELECT i.id, CASE WHEN action = 'modified' THEN disk_hash ELSE file_hash END AS file_hash, CASE action WHEN 'modified' THEN 'DONE' WHEN 'failed' THEN 'FAILED' ELSE hash_status END AS hash_status,
  CASE WHEN action IN ('touched', 'modified', 'failed') THEN disk_size ELSE file_size END AS file_size, semantic_analysis_done AND action <> 'modified' AS semantic_analysis_done, CASE WHEN action <> 'modified' THEN thumbnail_path END AS thumbnail_path,
  CASE WHEN action = 'delete' THEN {NOW} WHEN action IN ('undelete', 'touched', 'modified') THEN NULL ELSE deleted_at END AS deleted_at FROM images i JOIN found f ON f.id = i.id""", "folders", "images")),
        "d5_hashes": (lambda c: M.apply_hashes(c.images, _hashes(c)).select("id", "file_hash", "hash_status"), sql("SELECT id, CASE WHEN id % 3 = 0 AND id % 9 <> 0 AND id % 2 = 0 THEN 'z' ELSE file_hash END AS file_hash, CASE WHEN id % 3 = 0 AND id % 9 <> 0 THEN CASE WHEN id % 2 = 0 THEN 'DONE' ELSE 'FAILED' END ELSE hash_status END AS hash_status FROM images", "images")),
        "d6_enqueued": (lambda c: M.enqueued(c.queue, c.queue.where("image_id % 5 = 0"), NOW), sql(f"SELECT image_id, pipeline, attempts, scheduled_at FROM queue WHERE image_id % 5 <> 0 UNION ALL SELECT image_id, p, 0, {NOW} FROM (SELECT DISTINCT image_id FROM queue WHERE image_id % 5 = 0), (VALUES ('semantic'), ('subject')) x(p)", "queue")),
        "d6_done": (lambda c: M.done(c.images, c.queue, c.queue.where("image_id % 5 = 0"), "semantic")[1].select("image_id", "pipeline"), sql("SELECT image_id, pipeline FROM queue WHERE NOT (image_id % 5 = 0 AND pipeline = 'semantic')", "queue")),
        "d7_failed": (lambda c: M.failed(c.queue, c.queue.where("image_id % 3 = 0"), NOW).select("id", "attempts", "scheduled_at"), sql(f"SELECT id, attempts + (image_id % 3 = 0)::INT AS attempts, CASE WHEN image_id % 3 = 0 THEN {NOW} + least(5 * pow(2, attempts), 120)::BIGINT ELSE scheduled_at END AS scheduled_at FROM queue WHERE image_id % 3 <> 0 OR attempts + 1 < 7", "queue")),
        "d8_reset": (lambda c: M.reset_embeddings(c.images, c.queue, NOW)[1].groupBy("pipeline").agg(F.count("*").alias("n")), sql("SELECT pipeline, count(*) AS n FROM images, (VALUES ('semantic'), ('subject')) p(pipeline) WHERE deleted_at IS NULL GROUP BY 1", "images")),
        "d8_stale": (lambda c: M.stale_subjects(c.images, c.queue, NOW)["queue"].groupBy("pipeline").agg(F.count("*").alias("n")), sql("all_ AS (SELECT image_id, pipeline FROM queue UNION ALL SELECT id, 'subject' FROM images WHERE deleted_at IS NULL AND id NOT IN (SELECT image_id FROM queue WHERE pipeline = 'subject')) >> SELECT pipeline, count(*) AS n FROM all_ GROUP BY 1", "queue")),
        "d9_tag_renamed": (lambda c: M.rename_tag(c.tags, 3, " Ärger ").select("id", "name", "name_normalized"), sql("SELECT id, CASE WHEN id = 3 THEN 'Ärger' ELSE name END AS name, CASE WHEN id = 3 THEN 'arger' ELSE name_normalized END AS name_normalized FROM tags", "tags")),
        "d9_tag_deleted": (lambda c: M.unlink_tag(M.delete_tag(c.tags, c.subject_tags, 3)[1], 4, 9).select("subject_id", "tag_id"), sql("SELECT subject_id, tag_id FROM subject_tags WHERE tag_id <> 3 AND NOT (subject_id = 4 AND tag_id = 9)", "subject_tags")),
        "d10_report_saved": (lambda c: M.save_report(*_reports(c), " Trip ", 2, [9, 4, 9, 1], NOW)[1].select("report_id", "pos", "tag_id"), sql(REPORTS + ">> SELECT report_id, pos, tag_id FROM report_tags UNION ALL SELECT 5, pos, tag_id FROM (VALUES (0, 9), (1, 4), (2, 1)) x(pos, tag_id)", "folders")),
        "d11_faces_deleted": (lambda c: M.delete_faces(c.face_vectors.select("id"), c.face_vectors.select("id"), _edges(c), _constraints(c), c.face_vectors.where("id % 7 = 0"))["edges"].select("face_a", "face_b"), sql(EDGES + ">> SELECT face_a, face_b FROM edges WHERE face_a NOT IN (SELECT id FROM face_vectors WHERE id % 7 = 0) AND face_b NOT IN (SELECT id FROM face_vectors WHERE id % 7 = 0)", "face_vectors")),
        "d11_setting_upsert": (lambda c: M.upsert(_settings(c), c.spark.createDataFrame([("k1", "new"), ("k9", "x")], "key string, value string"), "key"), "SELECT 'k' || n_nationkey AS key, CASE n_nationkey WHEN 1 THEN 'new' WHEN 9 THEN 'x' ELSE n_name END AS value FROM nation"),
        "d12_thumbnail_set": (lambda c: M.set_thumbnail(c.subjects, c.faces, _face(c)[1], _face(c)[0]).select("id", "thumbnail_face_id"), sql("f AS (SELECT id, subject_id FROM faces WHERE subject_id IS NOT NULL ORDER BY id LIMIT 1) >> SELECT s.id, f.id AS thumbnail_face_id FROM subjects s LEFT JOIN f ON f.subject_id = s.id", "subjects", "faces")),
        "d13_setting": (lambda c: M.setting(_settings(c), "none", "base"), "SELECT 'none' AS key, 'base' AS value"),
        "d14_inserted": (lambda c: M.insert(c.folders, c.subjects.where("id < 3").select(F.concat(F.lit("/n/"), F.col("id").cast("string")).alias("path"), F.lit(1).cast("long").alias("added_at")), F.col("path")), sql("SELECT * FROM folders UNION ALL SELECT 24 + row_number() OVER (ORDER BY id), '/n/' || id, 1 FROM subjects WHERE id < 3", "folders", "subjects")),
        "d15_renamed": (lambda c: M.set_where(c.subjects, F.col("id") == 3, name="New").select("id", "name"), sql("SELECT id, CASE WHEN id = 3 THEN 'New' ELSE name END AS name FROM subjects", "subjects")),
        "d16_cleared": (lambda c: M.cleared(_suggested(c)), sql(SUGGESTED + "SELECT * FROM pairs WHERE false", "subjects")),
        "d17_thumbnails": (lambda c: M.with_thumbnails(_thumbed(c), c.faces, upgrade=True).select("id", "thumbnail_face_id"), sql(_BEST + ", " + THUMBED + ">> SELECT t.id, coalesce(b.face_id, t.thumbnail_face_id) AS thumbnail_face_id FROM thumbed t LEFT JOIN best b ON b.subject_id = t.id AND b.rank = 1", "faces", "subjects")),
        # events
        "t1_bursts": (lambda c: T.bursts(c.fs_events, 21600).select("path", F.date_format("first", "yyyy-MM-dd HH:mm:ss").alias("first"), "n"), sql(BURSTS + ">> SELECT path, strftime(first, '%Y-%m-%d %H:%M:%S') AS first, n FROM listed", EV)),
        "t2_coalesced": (lambda c: T.bursts(c.fs_events, 21600).select("path", F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("last"), "kind"), sql(BURSTS + ">> SELECT path, strftime(last, '%Y-%m-%d %H:%M:%S') AS last, kind FROM folded", EV)),
        "t3_applied": (lambda c: T.bursts(c.fs_events, 21600).where("kind <> ''").groupBy("kind").agg(F.count("*").alias("n")), sql(BURSTS + ">> SELECT kind, count(*) AS n FROM folded WHERE kind <> '' GROUP BY 1", EV)),
        "t4_throttled": (lambda c: T.throttled(c.fs_events, 86400).select("path", F.col("slot").cast("long").alias("slot"), "event_id"), sql("slots AS (SELECT *, (epoch(date_trunc('second', ts))::BIGINT - first(epoch(date_trunc('second', ts))::BIGINT) OVER (PARTITION BY path ORDER BY ts, event_id)) // 86400 AS slot FROM fs_events) >> SELECT path, slot, arg_max(event_id, (ts, event_id)) AS event_id FROM slots GROUP BY 1, 2", EV)),
        "t5_rates": (lambda c: T.rates(_samples(c), 7200, ("user_id",)).select("user_id", "t", _r(F.col("rate")).alias("rate")), sql(SAMPLES + f">> SELECT user_id, t, round({RATE}, 6) AS rate FROM samples WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN 7200 PRECEDING AND CURRENT ROW)")),
        "t6_segments": (lambda c: T.rates(T.idle_segments(_samples(c), ("user_id",)), 7200, ("user_id", "segment")).select("user_id", "t", "segment", _r(F.when(F.col("pending") == 0, 0.0).otherwise(F.col("rate"))).alias("rate")), sql(SAMPLES + f", seg AS (SELECT *, sum((pending = 0)::INT) OVER (PARTITION BY user_id ORDER BY t)::BIGINT AS segment FROM ticks) >> SELECT user_id, t, segment, CASE WHEN pending = 0 THEN 0 ELSE round({RATE}, 6) END AS rate FROM seg WINDOW w AS (PARTITION BY user_id, segment ORDER BY t RANGE BETWEEN 7200 PRECEDING AND CURRENT ROW)")),
        "t9_priorities": (lambda c: layout.priorities(c.queue.select("image_id", (F.col("attempts") % 2).alias("priority"), "id")), sql("best AS (SELECT image_id, max(attempts % 2) AS priority, min(id) AS seq FROM queue GROUP BY 1) >> SELECT image_id, priority, row_number() OVER (ORDER BY priority DESC, seq)::INT AS place FROM best", "queue")),
        "t10_visible": (lambda c: c.queue.where(F.col("scheduled_at") <= NOW - 200_000_000).groupBy("pipeline").agg(F.count("*").alias("n")), sql(f"SELECT pipeline, count(*) AS n FROM queue WHERE scheduled_at <= {NOW} - 200000000 GROUP BY 1", "queue")),
        "t12_windows": (lambda c: T.windowed_counts(c.fs_events, "1 day", "12 hours").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n"), sql("SELECT strftime(time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL (k * 12) HOUR, '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM fs_events, range(2) r(k) GROUP BY 1", EV)),
        "t16_sampled": (lambda c: T.done_deltas(_samples(c).withColumnRenamed("n", "done"), ("user_id",)).select("user_id", "t", F.col("n").cast("long").alias("n")), sql(SAMPLES + ">> SELECT user_id, t, greatest(n - coalesce(lag(n) OVER (PARTITION BY user_id ORDER BY t), n), 0) AS n FROM samples")),
        "t17_preview_work": (lambda c: L.needs_preview(c.images).where("preview_path is null").select("id"), sql("SELECT id FROM images WHERE deleted_at IS NULL AND thumbnail_path IS NULL AND preview_path IS NULL", "images")),
    }


def _affected(c: Catalog):
    new = c.face_vectors.where("id < 10")
    near = V.all_pairs_top(new.withColumn("k", F.lit(6)), c.face_vectors)
    return new.select("id").union(near.select("other")).distinct()


def _pairwise(c: Catalog):
    v = c.face_vectors
    a = v.select(F.col("id").alias("a"), F.col("embedding").alias("x"), (F.col("id") + 1).alias("b"))
    return a.join(v.select(F.col("id").alias("b"), F.col("embedding").alias("y")), "b")


def _marks():
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    k = F.col("p_partkey")
    return F.array(at(F.lit(0.3), F.lit(0.4)), at(0.3 + F.col("p_size") / 100.0, 0.4 + (k % 7) / 50.0), at(0.3 + (k % 11) / 40.0, F.lit(0.5)), at(F.lit(0.3), F.lit(0.6)), at(F.lit(0.5), F.lit(0.6)))


def _targets(c: Catalog):
    s = c.subjects
    a = s.select(F.col("id").alias("subject_id_a"), F.col("name").isNotNull().alias("na"))
    b = s.select(F.col("id").alias("subject_id_b"), F.col("name").isNotNull().alias("nb"))
    rows = _suggested(c).join(a, "subject_id_a").join(b, "subject_id_b")
    return rows.select("id", F.when(F.col("na") & ~F.col("nb"), F.col("subject_id_a")).when(F.col("nb") & ~F.col("na"), F.col("subject_id_b")).otherwise(F.least("subject_id_a", "subject_id_b")).alias("target"))


def _described(c: Catalog):
    rows = _reports(c)[1].join(c.tags.select(F.col("id").alias("tag_id"), "name"), "tag_id", "left")
    listed = F.sort_array(F.collect_list(F.struct("pos", F.coalesce("name", F.lit("Unknown")).alias("name"))))
    return rows.groupBy("report_id").agg(F.array_join(F.transform(listed, lambda t: t["name"]), ", ").alias("description"))


def _chains(c: Catalog):
    e = _edges(c).select(F.col("face_a").alias("a"), F.col("face_b").alias("b"))
    return G.components(c.face_vectors.select("id"), e).select("id", F.col("component").alias("cluster"))


def _relabelled(c: Catalog):
    subjects = _labels(c).select("id", "name", F.lit(None).cast("long").alias("thumbnail_face_id"), F.lit("person").alias("type"), F.lit(0).cast("long").alias("added_at"))
    faces, clusters = c.face_vectors.select("id", "subject_id"), _chains(c)
    faces, subjects = M.apply_labels(clusters, G.label_actions(clusters, faces, _labels(c)), faces, subjects, NOW)
    return faces.join(subjects.select(F.col("id").alias("subject_id"), "name"), "subject_id", "left").select("id", "subject_id", "name")


def _pair_scores(c: Catalog):
    own = lambda side: c.face_vectors.where("subject_id is not null").select(F.col("id").alias(f"face_{side}"), F.col("subject_id").alias(f"s_{side}"))
    rows = _mutual(c).join(own("a"), "face_a").join(own("b"), "face_b").where("s_a <> s_b")
    return rows.groupBy(F.least("s_a", "s_b").alias("lo"), F.greatest("s_a", "s_b").alias("hi")).agg(_r(F.max("weight")).alias("score"))


def _face(c: Catalog) -> tuple[int, int]:
    r = c.faces.where("subject_id is not null").orderBy("id").select("id", "subject_id").first()
    return r["id"], r["subject_id"]


def _unassigned(c: Catalog):
    t = _people(c)
    low = t["faces"].where("subject_id = 3").agg(F.min("id").alias("id")).first()["id"]
    return M.unassign_face(t, low, NOW)["constraints"].where(F.col("created_at") == NOW).select("face_a", "face_b", "source")


def _counts(tables: dict, names: tuple[str, ...]):
    out = None
    for n in names:
        row = tables[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def _hashes(c: Catalog):
    return c.images.where("id % 3 = 0").select("id", (F.col("mtime") + F.when(F.col("id") % 9 == 0, 1).otherwise(0)).alias("mtime"), F.when(F.col("id") % 2 == 0, F.lit("z")).alias("hash"))


def _settings(c: Catalog):
    return c.raw("nation").select(F.concat(F.lit("k"), F.col("n_nationkey").cast("string")).alias("key"), F.col("n_name").alias("value"))
