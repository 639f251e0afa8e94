"""The catalogue of surveys: one JSON document each, projected, joined and put in order with DataFrame functions."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orograph.functions import text as T
from orograph.shared import numbered

#: The documents' own field names.
SCHEMA = """slug string, title string, lugar string, municipio string, fecha string, lat double, lon double, coordenadas_aprox boolean,
dron string, camara string, fotos bigint, altura_m double, captura string, gsd_cm double, descripcion string, estado string, miniatura string, licencia string,
modelo struct<tipo:string,tileset:string,peso_inicial_mb:double,zUp:boolean,up:string,tileset_geo:string>,
escena struct<geoide_m:double,suelo_borde_m:double,ajuste_altura_m:double,peso_inicial_mb:double,
inclinacion:struct<este:double,norte:double,z_pivote:double>,camara:struct<azimut_grados:double,elevacion_grados:double,distancia_m:double>>"""
GEO_SCHEMA = "type string, features array<struct<geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>, geometry struct<type:string,coordinates:string>, coordinates string, properties map<string,string>"
RING = "array<struct<lon:double,lat:double>>"


def read_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """All documents of a folder but those whose name starts with ``_``; the key is the file's name unless the document has its own. No rows
    where the folder is missing."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.schema(SCHEMA).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    except AnalysisException:
        return spark.createDataFrame([], SCHEMA)
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
    rows = rows.withColumn("__file", name).where(~F.col("__file").startswith("_") & ~F.col("__file").endswith(".huella"))
    return rows.withColumn("slug", F.coalesce("slug", "__file")).drop("__file")


def by_key(catalogue: DataFrame, slug: str) -> DataFrame:
    """The document of a key; none for a key that starts with ``_``."""
    return catalogue.where((F.col("slug") == slug) & ~F.lit(slug).startswith("_"))


def ring_of(geojson: Column) -> Column:
    """The outer ring of a Polygon given as collection, feature or bare geometry; null for other kinds and for rings of fewer than four points."""
    g = F.from_json(geojson, GEO_SCHEMA)
    shape = F.coalesce(F.get(g["features"], F.lit(0))["geometry"], g["geometry"], F.when(g["coordinates"].isNotNull(), F.struct(g["type"].alias("type"), g["coordinates"].alias("coordinates"))))
    outer = F.get(F.from_json(shape["coordinates"], "array<array<array<double>>>"), F.lit(0))
    ring = F.transform(outer, lambda p: F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat")))
    return F.when((shape["type"] == "Polygon") & (F.size(outer) >= 4), ring)


def read_footprints(spark: SparkSession, folder: str, suffix: str = ".huella.geojson") -> DataFrame:
    rows = spark.read.option("wholetext", True).option("pathGlobFilter", f"*{suffix}").text(folder)
    return rows.select(F.regexp_replace(F.col("_metadata.file_name"), suffix.replace(".", r"\.") + "$", "").alias("slug"), ring_of(F.col("value")).alias("ring"))


def with_footprints(catalogue: DataFrame, footprints: DataFrame) -> DataFrame:
    return catalogue.join(footprints, "slug", "left")


def order() -> list[Column]:
    """Dates as text, latest first and without a date last; then keys in the order of the alphabet."""
    return [F.coalesce("fecha", F.lit("")).desc(), F.collate(F.col("slug"), "UNICODE")]


def in_order(catalogue: DataFrame) -> DataFrame:
    """The catalogue by ``order``."""
    return catalogue.orderBy(*order())


def scene_of(base: str) -> Column:
    """What a scene needs of a survey, or null: it must have a georeferenced tileset and a geoid height."""
    e = F.col("escena")
    tileset = T.joined_url(base, F.col("modelo.tileset_geo"))
    tilt = F.when(T.is_number(e["inclinacion"]["este"]) & T.is_number(e["inclinacion"]["norte"]), e["inclinacion"])
    fields = F.struct(tileset.alias("tileset"), e["geoide_m"].alias("geoid"), T.number_or_null(e["ajuste_altura_m"]).alias("adjust"), e["camara"].alias("camera"), tilt.alias("tilt"), T.number_or_null(e["suelo_borde_m"]).alias("ground"), T.number_or_null(e["peso_inicial_mb"]).alias("weight_mb"))
    return F.when((tileset != "") & T.is_number(e["geoide_m"]), fields)


def for_scene(catalogue: DataFrame, base: str) -> DataFrame:
    """The few columns that a scene is sent."""
    return catalogue.select("slug", "title", "lugar", "lat", "lon", "estado", scene_of(base).alias("scene"), *(c for c in ("ring",) if c in catalogue.columns))


def card(with_licence: bool = True) -> Column:
    """array<struct<field, value>> of what is known of a survey, in a fixed order."""
    place = F.when(~F.coalesce(F.startswith(F.col("municipio"), F.col("lugar")), F.lit(False)), F.nullif(F.col("lugar"), F.lit("")))
    where = F.concat_ws(", ", place, F.nullif(F.col("municipio"), F.lit("")))
    position = T.coordinates("lat", "lon")
    unit = lambda c, u: F.when(T.is_number(c), F.concat(T.grouped_number(c), F.lit(u)))
    pairs = [("Lugar", where), ("Coordenadas", F.concat(position, F.when(F.col("coordenadas_aprox"), " (aproximadas)").otherwise(""))), ("Fotos", unit("fotos", "")), ("Captura", F.col("captura")), ("Altura de vuelo", unit("altura_m", " m")), ("GSD", unit("gsd_cm", " cm/px")), ("Dron", F.col("dron")), ("Cámara", F.col("camara"))]
    if with_licence:
        pairs.append(("Licencia del modelo", F.col("licencia")))
    all_ = F.array(*(F.struct(F.lit(k).alias("field"), v.alias("value")) for k, v in pairs))
    return F.filter(all_, lambda p: p["value"].isNotNull() & (p["value"] != ""))


def card_rows(catalogue: DataFrame, with_licence: bool = True, without=()) -> DataFrame:
    rows = catalogue.select("slug", F.posexplode(card(with_licence)).alias("pos", "p")).select("slug", "pos", "p.*")
    return rows.where(~F.col("field").isin(*without)) if without else rows


def with_date_first(card_: Column) -> Column:
    date = F.struct(F.lit("Fecha").alias("field"), T.survey_date("fecha").alias("value"))
    return F.when(F.coalesce("fecha", F.lit("")) != "", F.concat(F.array(date), card_)).otherwise(card_)


def place_name(default: str = "") -> Column:
    return F.coalesce(T.first_text("municipio", "lugar"), F.lit(default))


def requested(requests: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Requested keys that are in the catalogue; others become null."""
    known = catalogue.select(F.col("slug").alias("__k")).distinct()
    return requests.join(known, F.col("slug") == F.col("__k"), "left").withColumn("slug", F.col("__k")).drop("__k")


def paths(catalogue: DataFrame) -> DataFrame:
    return catalogue.select("slug")


def chosen_style(choices: DataFrame, styles: DataFrame) -> DataFrame:
    """Each choice's style (styles: style_id, ord, ...), else the first one."""
    first = styles.orderBy("ord").limit(1).select(F.col("style_id").alias("__first"))
    known = styles.select(F.col("style_id").alias("__known"))
    return choices.join(known, F.col("style_id") == F.col("__known"), "left").crossJoin(F.broadcast(first)).withColumn("style_id", F.coalesce("__known", "__first")).drop("__known", "__first")


def counts_by_status(catalogue: DataFrame, base: str = "https://tiles.example") -> DataFrame:
    """How many have a model, and how many are in progress; a status nobody has makes no row."""
    rows = catalogue.agg(F.count_if(F.coalesce(F.col("estado") == "publicado", F.lit(False))).alias("publicado"), F.count_if(F.coalesce(F.col("estado") == "en proceso", F.lit(False))).alias("en proceso"))
    return rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("estado"), F.col(f"`{c}`").alias("n")) for c in ("publicado", "en proceso")))).alias("r")).select("r.*").where("n > 0")


def active_key(df: DataFrame, active: Column) -> DataFrame:
    """The keys of active rows in order, joined by +; - for none."""
    keys = F.array_sort(F.collect_list(F.when(active, F.col("slug"))))
    return df.agg(F.when(F.size(keys) > 0, F.array_join(keys, "+")).otherwise("-").alias("key"))


def priority(selected, highlighted, has_model: Column) -> Column:
    """0 for the selected survey, 1 for the highlighted one, 2 with a model, 3 for the rest."""
    return F.when(F.col("slug") == selected, 0).when(F.col("slug") == highlighted, 1).when(has_model, 2).otherwise(3)


def by_priority(df: DataFrame, selected, highlighted, has_model: Column, position) -> DataFrame:
    """Adds ``place`` (from 1) by ``priority``; within one by position."""
    return numbered(df, [priority(selected, highlighted, has_model), F.col(position)], "place").withColumn("place", F.col("place") + 1)


def sitemap(catalogue: DataFrame, base: str) -> DataFrame:
    """The root and one address a survey, in the catalogue's order, as one XML text."""
    at = F.when(F.coalesce("fecha", F.lit("")) == "", "").otherwise(F.col("fecha"))
    pages = catalogue.select(F.lit(1).alias("part"), at.alias("d"), "slug", F.concat(F.lit(base + "/vuelos/"), "slug").alias("loc"))
    root = catalogue.sparkSession.createDataFrame([(0, "", "", base + "/")], pages.schema)
    entries = root.unionByName(pages)
    # one text by nature: the protocol allows 50,000 addresses in a file
    order = F.array_sort(F.collect_list(F.struct("part", "d", "slug", "loc")), lambda a, b: F.when(a["part"] != b["part"], a["part"] - b["part"]).when(a["d"] != b["d"], F.when(a["d"] > b["d"], -1).otherwise(1)).when(a["slug"] < b["slug"], -1).when(a["slug"] > b["slug"], 1).otherwise(0))
    body = F.array_join(F.transform(order, lambda e: F.concat(F.lit("<url><loc>"), e["loc"], F.lit("</loc></url>"))), "")
    return entries.agg(F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), body, F.lit("</urlset>")).alias("xml"))


def robots(spark: SparkSession, base: str) -> DataFrame:
    return spark.range(1).select(F.array_join(F.array(F.lit("User-agent: *"), F.lit("Allow: /"), F.lit(f"Sitemap: {base}/sitemap.xml")), "\n").alias("text"))


def collected_reports(slugs: DataFrame, reports: DataFrame, notes: DataFrame | None = None, default_note: str = "") -> DataFrame:
    """A row for each wanted key: its report, or ``state = 'failed'``; with its note."""
    out = slugs.join(reports.withColumn("__has", F.lit(True)), "slug", "left").withColumn("state", F.when(F.col("__has"), "done").otherwise("failed")).drop("__has")
    return out if notes is None else out.join(notes, "slug", "left").withColumn("note", F.coalesce("note", F.lit(default_note)))


def report_totals(reports: DataFrame) -> DataFrame:
    done = F.col("state") == "done"
    from orograph.functions import quantiles as Q

    return reports.agg(F.count_if(done).alias("surveys"), Q.fixed(F.sum(F.when(done, F.col("total_mb"))), 1).alias("total_mb"), F.sum(F.when(done, F.col("files"))).alias("files"), F.count_if(~done).alias("failed"))
