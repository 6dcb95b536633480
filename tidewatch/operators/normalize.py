"""Raw nested posts (JSON text) -> flat typed rows of POST_SCHEMA, plus rejects.

The raw record is parsed once into a VARIANT; every field is a `variant_get` path, so
the whole normalizer is one projection (JVM-side) plus two joins: the gazetteer (place
names -> coordinates, distinct names looked up once) and the country layer (J1).
Per-record failures never abort the job: they become rows of the `rejects` DataFrame
with a reason.
"""

from __future__ import annotations

import json
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from tidewatch import schema
from tidewatch.functions.geo import mean_point
from tidewatch.functions.language import language_of
from tidewatch.functions.text import HASHTAG_STRIP, analyzed_words, token_words, tokens_from_words
from tidewatch.operators.aggs import outcome_counts
from tidewatch.operators.geojoin import country_of, place_key
from tidewatch.operators.keyed import latest_per_key, upsert
from tidewatch.sources.ingest import conform
from tidewatch.session import written

# The author fields kept.
PRESERVE_USER = ("id", "name", "screen_name", "location", "description", "followers_count", "friends_count",
                 "listed_count", "favourites_count", "statuses_count", "created_at", "utc_offset", "time_zone",
                 "lang", "profile_image_url")

# Very common words per supported language (language profiles).
LANGUAGE_PROFILES = {
    "en": ("the", "and", "of", "to", "is", "in", "that", "it", "was", "for", "with", "are", "this", "on", "you",
           "have", "be", "at", "not", "by", "from", "they", "we", "our", "has"),
    "fr": ("le", "la", "les", "des", "est", "et", "une", "du", "dans", "qui", "pour", "pas", "que", "de", "un",
           "au", "aux", "sur", "ce", "il", "elle", "sont", "avec", "mais", "nous"),
    "es": ("el", "los", "las", "del", "y", "es", "una", "por", "con", "para", "que", "se", "en", "de", "la",
           "un", "al", "lo", "como", "pero", "esta", "este", "muy", "hay", "sin"),
    "de": ("der", "die", "das", "und", "ist", "nicht", "ein", "eine", "zu", "den", "mit", "sich", "von", "im",
           "auf", "dem", "des", "auch", "es", "wird", "sind", "wir", "ich", "bei", "nach"),
}


def _get(v: Column, path: str, typ: str = "string") -> Column:
    return F.try_variant_get(v, path, typ)


def _has(v: Column, key: str) -> Column:
    """True when the object has the key (even with a JSON null value)."""
    return F.variant_get(v, f"$.{key}", "variant").isNotNull()


def _envelope_is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$.tweet", "map<string,variant>").isNotNull()


def envelope_text(v: Column) -> Column:
    """The envelope's JSON text when it arrived as a JSON string (else NULL)."""
    return F.when(~_envelope_is_object(v), _get(v, "$.tweet", "string"))


def lift_envelope(v: Column) -> Column:
    """The inner `tweet` record (object, or JSON string parsed); NULL without one.
    Field reads prefer it over the outer record (see `top_value`)."""
    tw = _get(v, "$.tweet", "variant")
    return F.when(_envelope_is_object(v), tw).otherwise(F.try_parse_json(envelope_text(v)))


# The record's keys that are read; each is looked up once per record, its fields inside it.
TOP_KEYS = ("annotations", "text", "lang", "coordinates", "place", "location", "user", "id", "created_at", "timestamp_ms",
            "country", "representative")


def top_value(v: Column, inner: Column, key: str) -> Column:
    """P2 for one lifted key: the inner record's value when it has the key (a JSON null too), else the outer's."""
    return F.coalesce(F.variant_get(inner, f"$.{key}", "variant"), F.variant_get(v, f"$.{key}", "variant"))


def flood_probability(annotations: Column) -> Column:
    """P5: scalar, or ["yes"|"no", p] -> p when "yes" else 0; missing -> NULL (rejected).
    The envelope's own `annotations` override the outer ones."""
    fp = _get(annotations, "$.flood_probability", "variant")
    is_arr = F.try_variant_get(fp, "$", "array<variant>").isNotNull()
    pair = F.when(_get(fp, "$[0]") == F.lit("yes"), _get(fp, "$[1]", "double")).otherwise(F.lit(0.0))
    return F.when(is_arr, pair).otherwise(_get(fp, "$", "double"))


def repair_timestamp(created_at: Column, timestamp_ms: Column, now: datetime | None = None) -> Column:
    """ISO datetime, else ISO date at midnight, else the epoch-millis field, else now."""
    iso = F.when(created_at.rlike(r"^\d{4}-\d{2}-\d{2}"), F.coalesce(  # failed parses are costly: try ISO only
        F.try_to_timestamp(created_at, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS][XXX][X]")),
        F.try_to_timestamp(created_at, F.lit("yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS][XXX]")),
        F.try_to_timestamp(created_at, F.lit("yyyy-MM-dd")),
    ))
    millis = F.when(timestamp_ms.rlike(r"^\d+$"), F.timestamp_millis(timestamp_ms.try_cast("bigint")))
    clock = F.lit(now.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp") if now else F.current_timestamp()
    return F.coalesce(iso, millis, clock)


def detect_language(text: Column, fallback: Column, words: Column | None = None) -> Column:
    """F12 (approximation): the supported language with the most distinct common words in
    the text; no hits -> the record's own language. `words` may pass pre-analyzed words."""
    words = analyzed_words(text) if words is None else words
    scores = []
    for lang, ws in LANGUAGE_PROFILES.items():
        profile = F.array(*[F.lit(x) for x in ws])
        hits = F.size(F.array_intersect(words, profile))  # distinct profile words present
        own = F.coalesce(fallback == F.lit(lang), F.lit(False))
        scores.append(F.struct(hits.alias("n"), own.alias("own"), F.lit(lang).alias("lang")))
    best = F.greatest(*scores)  # most hits; ties go to the record's own language
    return F.when(best["n"] > 0, best["lang"]).otherwise(fallback)


def _merged_record(raw: str) -> dict:
    """The record as a dict with its envelope lifted; {} when it cannot be read."""
    try:
        rec = json.loads(raw)
        inner = rec.pop("tweet", None) if isinstance(rec, dict) else None
        if isinstance(inner, str):
            inner = json.loads(inner)
    except (TypeError, ValueError, RecursionError):
        return {}
    if not isinstance(rec, dict):
        return {}
    return {**rec, **inner} if isinstance(inner, dict) else rec


def _entity_tags(items: list) -> list:
    """X5 for one list: each object's `hashtags` sub-list, else its own `text`."""
    out = []
    for item in (x for x in items if isinstance(x, dict)):
        subs = item["hashtags"] if isinstance(item.get("hashtags"), list) else [item]
        names = [x.get("text") if isinstance(x, dict) else x for x in subs]
        out += [x.strip() for x in names if isinstance(x, str)]
    return out


def record_tags(raw: str) -> tuple[list, list]:
    """(hashtags, media URLs) of one raw record, each distinct and sorted."""
    tags, media = set(), set()
    todo = [_merged_record(raw)]
    while todo:
        for val in todo.pop().values():
            if isinstance(val, dict):
                todo.append(val)
            elif isinstance(val, list):
                tags.update(_entity_tags(val))
                urls = (x.get(k) for x in val if isinstance(x, dict) for k in ("media_url", "media_url_https"))
                media.update(u for u in urls if isinstance(u, str))
            elif isinstance(val, str) and "#" in val:
                tags.update(w.strip(HASHTAG_STRIP) for w in val.split() if w.startswith("#") and len(w) < 256)
    return sorted(tags - {""}), sorted(media)


_STRINGS = ArrayType(StringType())
#: Records whose tags are held as Python objects at a time.
_WALKED = 500


@F.arrow_udf(StructType([StructField("tags", _STRINGS), StructField("media", _STRINGS)]))  # a DDL text would need a session at import
def walk_record(raw: pa.Array) -> pa.Array:
    """Hashtags and media URLs of whole records, read from the parsed JSON.

    Hashtags are the `#words` (X4 rules) of every string in nested objects, plus the entity
    texts of lists; media URLs are `media_url` / `media_url_https` of objects in lists. Both
    at any depth of nested objects; the envelope's keys override the outer ones. The walk needs
    unbounded depth, which no JVM expression has. Of an Arrow batch one record, and the tags of `_WALKED`, are Python objects at a time.
    """
    parts = []
    for at in range(0, len(raw), _WALKED):
        tags, media = zip(*(record_tags(r.as_py()) for r in raw.slice(at, _WALKED)))
        parts.append(pa.StructArray.from_arrays([pa.array(tags, pa.list_(pa.string())), pa.array(media, pa.list_(pa.string()))], ["tags", "media"]))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("tags", pa.list_(pa.string())), ("media", pa.list_(pa.string()))]))


def normalize(raw: DataFrame, gazetteer: DataFrame | None = None, countries: DataFrame | None = None,
              raw_col: str = "raw", now: datetime | None = None, languages=schema.LANGUAGES,
              prefer_user_place: bool = True, detect: bool = True,
              use_text_places: bool = True, profiles: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Full normalization -> (ok rows in POST_SCHEMA, rejects(raw, reason)).

    language -> timestamp -> geotag (point, bounding-box mean, location point/ring,
    geocoded place, geocoded author place) -> country (polygon, overridden by the
    structured place's country) -> hashtags/media from the whole record -> flatten ->
    tokens (+hashtags) -> conform. The language is that of the nearest n-gram profile if `profiles`
    are given (`functions.language`), else of the most common words; the record's own where there is none.
    """
    v0 = F.try_parse_json(F.col(raw_col))
    base = raw.select(F.col(raw_col).alias("_raw"), v0.alias("_v"))
    v = F.col("_v")
    base = base.select("*", lift_envelope(v).alias("_in"))
    base = base.select("_raw", v.isNotNull().alias("_parsed"), F.coalesce(_has(v, "annotations"), F.lit(False)).alias("_has_ann"),
                       *[top_value(v, F.col("_in"), k).alias(f"_top_{k}") for k in TOP_KEYS])

    def g(path: str, typ: str = "string") -> Column:
        top, _, rest = path[2:].partition(".")
        return _get(F.col(f"_top_{top}"), f"$.{rest}" if rest else "$", typ)

    base = base.select("*", g("$.text").alias("text"), g("$.lang").alias("_lang_in"))
    fp = flood_probability(F.col("_top_annotations"))

    # X11: point, bounding-box ring mean, location point or ring
    coord_lon, coord_lat = g("$.coordinates.coordinates[0]", "double"), g("$.coordinates.coordinates[1]", "double")
    point = F.when(coord_lat.isNotNull() & coord_lon.isNotNull(), F.struct(coord_lat.alias("lat"), coord_lon.alias("lon")))
    bbox = g("$.place.bounding_box.coordinates", "array<array<array<double>>>")
    ring_mean = mean_point(F.element_at(bbox, 1))
    loc_point = g("$.location.geo.coordinates", "array<double>")
    loc_ring = g("$.location.geo.coordinates", "array<array<double>>")
    loc_geo_pt = F.coalesce(
        F.when(F.size(loc_point) == 2, F.struct(loc_point[1].alias("lat"), loc_point[0].alias("lon"))),
        mean_point(loc_ring))
    place_struct = F.trim(F.coalesce(g("$.place.full_name"), g("$.place.name")))
    user_place = F.trim(F.coalesce(g("$.user.location"), g("$.user.derived.locations[0].locality")))

    df = base.select(
        "_raw",
        # compact record key for the joins below: two independent hashes and the length
        F.struct(F.xxhash64("_raw").alias("h1"), F.hash("_raw").alias("h2"), F.length("_raw").alias("n")).alias("_rk"),
        g("$.id").alias("_id"),
        "text",
        "_lang_in",
        token_words("text").alias("_words"),  # analyzed once: language check and tokens
        fp.alias("flood_probability"),
        repair_timestamp(g("$.created_at"), g("$.timestamp_ms")).alias("created_at") if now is None
        else repair_timestamp(g("$.created_at"), g("$.timestamp_ms"), now).alias("created_at"),
        F.coalesce(point, ring_mean, loc_geo_pt).alias("_loc_direct"),
        place_struct.alias("_place_tweet"),
        user_place.alias("_place_user"),
        g("$.place.country").alias("_place_country"),
        g("$.place.name").alias("_place_name"),
        F.trim(g("$.place")).alias("_place_str"),
        *[g(f"$.user.{k}", "bigint" if k.endswith("count") or k in ("id", "utc_offset") else "string")
          .alias(f"user_{k}") for k in PRESERVE_USER],
        g("$.country").alias("_own_country"),
        g("$.representative", "boolean").alias("representative"),
        "_parsed",
        "_has_ann",
    )
    if detect and profiles:
        lang = F.coalesce(language_of("text", profiles), F.col("_lang_in"))
    else:
        lang = detect_language(F.col("text"), F.col("_lang_in"), F.col("_words")) if detect else F.col("_lang_in")
    df = df.withColumn("lang", lang)
    reason = (F.when(~F.col("_parsed"), F.lit("unparsable record"))
              .when(~F.col("_has_ann"), F.lit("missing annotations"))
              .when(F.col("flood_probability").isNull(), F.lit("missing flood_probability"))
              .when(F.col("_id").isNull(), F.lit("missing id"))
              .when(~F.col("lang").isin(list(languages)), F.concat(F.lit("unsupported language: "), F.coalesce(F.col("lang"), F.lit("null")))))
    df = df.withColumn("_reason", reason)
    # both Python steps in one projection: a task has one Python worker for them, and the stages of the joins have none for the stems
    df = df.select("*", walk_record("_raw").alias("_walk"), tokens_from_words(F.col("_words"), F.col("lang")).alias("_tokens"))
    df = df.select("*", F.col("_walk.tags").alias("_tags"), F.col("_walk.media").alias("media_urls"))
    df = df.withColumn("_raw", F.when(F.col("_reason").isNotNull(), F.col("_raw"))).drop("_parsed", "_has_ann", "_lang_in", "_words", "_walk")
    # every field is extracted once per record; the joins below (gazetteer, text places,
    # polygons) reuse this written stage instead of re-reading and re-parsing the input, and
    # take the rows that are not rejected
    df = written(df, "normalize")
    rejects = df.where("_reason is not null").select(F.col("_raw").alias("raw"), F.col("_reason").alias("reason"))
    df = df.where("_reason is null").drop("_raw", "_reason")
    # X13 + J2: geocode place names (distinct keys once) when no direct location
    if gazetteer is not None:
        gz = gazetteer.select(place_key("place").alias("_pk"), F.struct("lat", "lon").alias("_g")).groupBy("_pk").agg(
            F.min("_g").alias("_g"))
        df = df.join(gz.withColumnRenamed("_pk", "_pk_t").withColumnRenamed("_g", "_g_t"),
                     place_key(F.col("_place_tweet")) == F.col("_pk_t"), "left").drop("_pk_t")
        df = df.join(gz.withColumnRenamed("_pk", "_pk_u").withColumnRenamed("_g", "_g_u"),
                     place_key(F.col("_place_user")) == F.col("_pk_u"), "left").drop("_pk_u")
        geo_t, geo_u = F.col("_g_t"), F.col("_g_u")
    else:
        geo_t = geo_u = F.lit(None).cast("struct<lat:double,lon:double>")
    loc = F.coalesce(F.col("_loc_direct"), geo_t, geo_u)
    # place chosen by the geotag step: the record's place name, or the author's place
    geo_place = F.when(F.col("_loc_direct").isNotNull() | geo_t.isNotNull(), F.col("_place_tweet")).when(
        geo_u.isNotNull(), F.col("_place_user"))
    if gazetteer is not None and use_text_places:
        # Exactly one place named in the text wins; several -> the nearest to the
        # record's (or author's) location, or the first when there is none
        from tidewatch.operators.geojoin import nearest_candidate, text_places

        tp = text_places(df.select("_rk", "text"), gazetteer, "_rk")
        df = df.join(tp, "_rk", "left").withColumn("_ref", loc)
        df = nearest_candidate(df.withColumn("_cands", F.coalesce(F.col("places"), F.array())), "_cands", "_ref")
        n_tp = F.size(F.col("_cands"))
        pick = F.when(n_tp == 1, F.element_at("_cands", 1)).when(n_tp > 1, F.col("nearest"))
        pick_loc = F.when(pick.isNotNull(), F.struct(pick["lat"].alias("lat"), pick["lon"].alias("lon")))
        geo_place = F.when(pick.isNotNull(), pick["place"]).otherwise(geo_place)
        loc = F.coalesce(pick_loc, loc)
        df = df.withColumn("_pick", pick)
    df = df.withColumn("location", loc).withColumn("_geo_place", geo_place)
    df = df.withColumn("tweetid", F.col("_id"))
    # X15 + J1: polygon country; when the geotag gave no place name, a structured place
    # supplies name and country; otherwise the author's place wins when present
    if countries is not None:
        df = country_of(df, countries, key="_rk", out="_poly_country")
    else:
        df = df.withColumn("_poly_country", F.lit(None).cast("string"))
    has_loc = F.col("location").isNotNull()
    struct_branch = has_loc & F.col("_geo_place").isNull() & F.col("_place_name").isNotNull()
    str_branch = has_loc & F.col("_geo_place").isNull() & F.col("_place_str").isNotNull()
    user_over = F.col("_place_user") if prefer_user_place else F.lit(None).cast("string")
    place = (F.when(struct_branch, F.col("_place_name"))
             .when(str_branch, F.col("_place_str"))
             .when(has_loc, F.coalesce(user_over, F.col("_geo_place"))))
    # a country already on the record is kept; only a structured place overrides it
    own = F.col("_own_country")
    country = F.when(struct_branch, F.coalesce(F.col("_place_country"), own, F.col("_poly_country"))).when(
        has_loc, F.coalesce(own, F.col("_poly_country"))).otherwise(own)
    df = df.withColumn("country", country).withColumn("place", place)
    tokens = F.array_distinct(F.concat("_tokens", "_tags"))
    df = df.withColumn("tokens", F.array_sort(tokens))
    ok = conform(df)
    return ok, rejects


def renormalize(df: DataFrame, gazetteer=None, countries=None, stored: bool = False, **kw) -> tuple[DataFrame, DataFrame]:
    """Re-run the normalizer over already-flat rows. The raw record is rebuilt from
    every POST_SCHEMA column (`annotations`, a point location, the author, media and earlier
    tokens as entities), so normalizing normalized rows changes nothing; one job, partitions
    replace batches. The rows are written first, unless `stored` says that they are read from a
    table: the optimizer would put the expressions that make them into every field read from the record."""
    df = conform(df) if stored else written(conform(df), "posts")
    user = [F.col(f"user_{k}").alias(k) for k in PRESERVE_USER if f"user_{k}" in schema.POST_SCHEMA.names]
    texts = F.transform("tokens", lambda t: F.struct(t.alias("text")))
    media = F.transform("media_urls", lambda u: F.struct(u.alias("media_url")))
    point = F.struct(F.lit("Point").alias("type"), F.array("location.lon", "location.lat").alias("coordinates"))
    rec = F.to_json(F.struct(
        F.col("tweetid").alias("id"), "text", "lang", "place", "country", "representative",
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("created_at"),
        F.struct("flood_probability").alias("annotations"),
        F.when(F.col("location").isNotNull(), point).alias("coordinates"),
        F.struct(*user).alias("user"),
        F.struct(texts.alias("hashtags"), media.alias("media")).alias("entities"),
    ))
    return normalize(df.select(rec.alias("raw")), gazetteer, countries, **kw)


def renormalize_into(base: DataFrame, stale: DataFrame, gazetteer=None, countries=None, key: str = "tweetid", **kw) -> tuple[DataFrame, DataFrame]:
    """S8 in one call: the rows of `stale` normalized again and written into `base` by key -> (new table, tally).

    `base` has the columns of POST_SCHEMA; of several rows of a key in `stale` the one with the latest
    created_at wins (then the larger record hash). The tally counts keys created and updated and rows failed;
    failed rows leave the table as it was.
    """
    ok, rejects = renormalize(stale, gazetteer, countries, **kw)
    order = F.struct(F.col("created_at").alias("t"), F.xxhash64(F.to_json(F.struct(*ok.columns))).alias("h"))
    updates = written(latest_per_key(ok.withColumn("_o", order), key, "_o").select(*ok.columns), "renormalized")  # read by the table and by the tally
    merged, outcomes = upsert(conform(base), updates, key)
    failed = rejects.select(F.lit("failed").alias("outcome"))
    return merged, outcome_counts(outcomes.select("outcome").unionByName(failed))
