"""Building, checking, selecting and exporting training records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from ..functions import keywords as K
from ..functions.text import first_full, length_bucket, simulate_recognition, strip
from .prefix import running_sum

# The share of each scene in the target data.
SCENES = {
    "daily_chat": 0.07, "english_daily": 0.08, "vibe_coding": 0.12, "explanation": 0.12, "meeting": 0.06, "english_meeting": 0.05,
    "customer_service": 0.06, "english_customer_service": 0.05, "academic": 0.04, "english_academic": 0.05, "navigation": 0.03,
    "dictation_memo": 0.05, "english_dictation": 0.05, "voice_search": 0.03, "english_voice_search": 0.04, "english_tech": 0.10,
}
DEFAULT_SHARE = 0.05


def least_length(scene: Column) -> Column:
    return F.when(F.startswith(scene, F.lit("english_")), 6).when(scene.isin("vibe_coding", "academic", "dictation_memo", "voice_search", "passthrough"), 8).otherwise(10)


def language(scene: Column, own: Column, meta: Column) -> Column:
    return first_full(own, meta, F.when(F.startswith(scene, F.lit("english_")), "en").otherwise("zh"))


def skip_reason(source: Column, target: Column, scene: Column) -> Column:
    """skipped_empty, skipped_short, or null for a usable pair."""
    empty = (F.coalesce(source, F.lit("")) == "") | (F.coalesce(target, F.lit("")) == "")
    return F.when(empty, "skipped_empty").when((F.length(strip(source)) < 2) | (F.length(strip(target)) < least_length(scene)), "skipped_short")


#: Fields of meta, as written by simulation and assembly.
META = {
    "scene": "string", "language": "string", "speech_phenomena": "array<string>", "itn_types": "array<string>", "is_fragment": "boolean", "asr_mode": "string",
    "asr_strength": "string", "keyword_mode": "string", "tts_provider": "string", "stt_provider": "string", "asr_fallback_text_sim": "boolean", "passthrough": "boolean",
}
KEYWORD_MODE = "review_targets"


def _meta(rows: DataFrame, over: dict[str, Column], under: dict[str, Column]) -> Column:
    """meta with ``over`` in place of its fields and ``under`` where it lacks them; other fields stay."""
    own = {f.name: F.col("meta")[f.name] for f in rows.schema["meta"].dataType.fields} if "meta" in rows.columns else {}
    fields = {k: F.lit(None).cast(t) for k, t in META.items() if k in over or k in under} | own
    fields |= {k: F.coalesce(fields[k], c) for k, c in under.items()} | over
    return F.struct(*[c.alias(k) for k, c in fields.items()])


def _own(rows: DataFrame, name: str, kind: str) -> Column:
    """A column of the record, or a typed null."""
    return F.col(name) if name in rows.columns else F.lit(None).cast(kind)


#: Where a record's keywords may stand beside ``output.keyword_list``, the first that has any counts.
KEYWORD_FIELDS = ("keyword_list", "review_targets", "domain_keywords", "error_keywords")


def _of_output(rows: DataFrame, name: str, kind: str) -> Column:
    held = "output" in rows.columns and isinstance(rows.schema["output"].dataType, StructType) and name in rows.schema["output"].dataType.fieldNames()
    return F.col("output")[name] if held else F.lit(None).cast(kind)


def keywords(rows: DataFrame) -> Column:
    """A record's own keywords, of the first field that has any; fields of other types or that are missing have none."""
    kinds = {f.name: f.dataType for f in rows.schema}
    texts = lambda kind: isinstance(kind, ArrayType) and isinstance(kind.elementType, StringType)
    own = [F.col(f"`{k}`") for k in KEYWORD_FIELDS if texts(kinds.get(k))]
    return K.first_words(_of_output(rows, "keyword_list", "array<string>"), *own)


def _of_meta(rows: DataFrame, name: str) -> Column:
    held = "meta" in rows.columns and name in rows.schema["meta"].dataType.fieldNames()
    return F.col("meta")[name] if held else F.lit(None).cast(META[name])


def assemble(rows: DataFrame, from_simulation: bool = True) -> DataFrame:
    """Training records (id, scene, input, oral_text, output, meta, reason) of simulated or clean records.

    Expects id, scene, oral_text, clean_text and, where there are, language, input, output (with refined_text and
    keyword_list), refined_text, other keyword fields (see ``keywords``), speech_phenomena, itn_types and meta (a struct). Of simulated records, meta keeps what it has and gets what it
    lacks; of clean ones, scene, language, phenomena and types are set, and the rest of meta stays. reason tells
    why a record is left out, and is null for records to keep."""
    none = F.array().cast("array<string>")
    oral, clean = F.coalesce(F.col("oral_text"), F.lit("")), F.coalesce(F.col("clean_text"), F.lit(""))
    own = language(F.col("scene"), _own(rows, "language", "string"), _of_meta(rows, "language"))
    if from_simulation:
        source = F.coalesce(_own(rows, "input", "string"), F.lit(""))
        target, said = first_full(_of_output(rows, "refined_text", "string"), _own(rows, "refined_text", "string"), clean), first_full(oral, source)
        made = {"scene": F.col("scene"), "language": own, "speech_phenomena": none, "itn_types": none, "is_fragment": F.lit(False), "keyword_mode": F.lit(KEYWORD_MODE)}
        meta = _meta(rows, {}, made)
    else:
        source, target, said = oral, clean, oral
        lists = {k: F.coalesce(_own(rows, k, "array<string>"), none) for k in ("speech_phenomena", "itn_types")}
        kept = {"is_fragment": F.lit(False), "asr_mode": F.lit("clean_fallback"), "keyword_mode": F.lit(KEYWORD_MODE)}
        meta = _meta(rows, {"scene": F.col("scene"), "language": own} | lists, kept)
    words = K.review_targets(keywords(rows), said, target)
    return rows.select(
        "id", "scene", source.alias("input"), said.alias("oral_text"), F.struct(target.alias("refined_text"), words.alias("keyword_list")).alias("output"),
        meta.alias("meta"), skip_reason(source, target, F.col("scene")).alias("reason"),
    )


MODES = ("text_sim", "llm_sim", "tts_asr")


def simulate(rows: DataFrame, mode: str = "text_sim", strength: str = "medium", share: float = 0.2, seed: int = 42, call=None, fallback: bool = True, tts: str | None = None, stt: str | None = None) -> DataFrame:
    """Recognition-like records (id, scene, input, oral_text, clean_text, output, meta) of (id, scene, oral_text, clean_text)
    and, where there are, language, speech_phenomena, itn_types, fields of keywords and meta. Rows without one text are left
    out.

    Clean passthrough rows have the clean text on both sides. Of the others, ``text_sim`` degrades every oral text;
    ``llm_sim`` sends the seeded ``share`` to ``call`` and leaves the rest as they are; ``tts_asr`` sends all, and where
    that failed degrades the text (``fallback``) or fails. ``call`` gets a DataFrame and adds said and wanted, its texts
    for input and target (null: failed; a null wanted alone keeps the clean text)."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    if mode != "text_sim" and call is None:
        raise ValueError(f"{mode} needs a call")
    none = F.array().cast("array<string>")
    lists = {k: F.coalesce(_own(rows, k, "array<string>"), _of_meta(rows, k), none) for k in ("speech_phenomena", "itn_types")}
    base = rows.where((F.coalesce("oral_text", F.lit("")) != "") & (F.coalesce("clean_text", F.lit("")) != ""))
    base = base.withColumn("_pass", passthrough(lists["speech_phenomena"], exact=True))
    sent = {"text_sim": F.lit(False), "llm_sim": draw(F.col("id"), share, seed), "tts_asr": F.lit(True)}[mode] & ~F.col("_pass")
    base = base.withColumn("_sent", sent)
    text = F.lit(None).cast("string")
    if mode == "text_sim":
        base = base.withColumn("said", text).withColumn("wanted", text)
    else:
        stay = base.where("NOT _sent").withColumn("said", text).withColumn("wanted", text)
        base = stay.unionByName(call(base.where("_sent")).select(*stay.columns))
    degraded, failed = simulate_recognition(F.col("oral_text"), strength), F.col("_sent") & F.col("said").isNull()
    failure = F.raise_error(F.concat(F.lit(f"{mode} failed for id "), F.col("id").cast("string"))).cast("string")
    instead = degraded if mode == "tts_asr" and fallback else failure
    rest = degraded if mode == "text_sim" else F.col("oral_text")
    source = F.when(F.col("_pass"), F.col("clean_text")).when(failed, instead).when(F.col("_sent"), F.col("said")).otherwise(rest)
    target = F.when(F.col("_sent") & F.col("wanted").isNotNull(), F.col("wanted")).otherwise(F.col("clean_text"))
    words = K.review_targets(keywords(rows), F.col("oral_text"), target)
    name = lambda x: F.lit(x if mode == "tts_asr" else None).cast("string")
    meta = _meta(base, {
        "scene": F.col("scene"), "language": first_full(_own(rows, "language", "string"), F.when(F.startswith("scene", F.lit("english_")), "en").otherwise("zh")), **lists,
        "is_fragment": F.col("_sent") & F.lit(mode == "llm_sim"), "asr_mode": F.lit(mode), "asr_strength": F.lit(strength), "keyword_mode": F.lit(KEYWORD_MODE),
        "tts_provider": name(tts), "stt_provider": name(stt), "asr_fallback_text_sim": failed & F.lit(mode == "tts_asr"), "passthrough": F.col("_pass"),
    }, {})
    return base.select("id", "scene", source.alias("input"), "oral_text", target.alias("clean_text"), F.struct(target.alias("refined_text"), words.alias("keyword_list")).alias("output"), meta.alias("meta"))


def passthrough(phenomena: Column, exact: bool = False) -> Column:
    return F.array_contains(phenomena, "clean") if exact else F.exists(phenomena, lambda p: F.lower(p).isin("clean", "passthrough"))


# --- quality checks ---


def precheck(source: Column, refined: Column) -> Column:
    """Why a pair is rejected before any model sees it; null if it isn't."""
    n, m = F.length(source), F.length(refined)
    empty = (F.coalesce(source, F.lit("")) == "") | (F.coalesce(refined, F.lit("")) == "")
    grown = F.concat(F.lit("abnormal expansion: input="), n.cast("string"), F.lit(" refined="), m.cast("string"))
    short = F.concat(F.lit("input is too short to contain substantive content: "), quoted(source))
    # The reasons, and the limits of growth and length.
    return F.when(empty, "input or refined_text is empty").when((m > n * 1.8) & (m - n > 30), grown).when(F.length(strip(source)) <= 2, short)


def quoted(text: Column) -> Column:
    """The text in quotes as Python writes it; control signs other than line ends and tabs stay as they are."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for sign, name in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    double = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), out, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(out, F.lit("'"), F.lit("\\'")), F.lit("'")))


def verdict(response: Column) -> Column:
    """(passed, reason) of a judge's answer. Of a JSON object, its own field ``pass`` counts: true if missing, else as any
    value that is not false, null, zero or empty; of other answers, whether they begin with true or false."""
    text = strip(response)
    doc = F.try_parse_json(text)
    said = F.try_variant_get(doc, "$.pass", "variant")
    kind, plain = F.schema_of_variant(said), F.to_json(said)
    false = (kind == "VOID") | plain.isin("false", '""', "[]", "{}") | (kind.rlike("^(BIGINT|DOUBLE|DECIMAL)") & (F.try_variant_get(said, "$", "double") == 0))
    told = F.coalesce(F.try_variant_get(doc, "$.reason", "string"), F.lit(""))
    low, start = F.lower(text), F.left(response, F.lit(100))
    result = lambda ok, why: F.struct(ok.alias("passed"), why.alias("reason"))
    begins = lambda x: F.startswith(low, F.lit(x)) | F.startswith(low, F.lit(f'{{"pass": {x}'))
    is_object = F.coalesce(F.startswith(F.schema_of_variant(doc), F.lit("OBJECT")), F.lit(False))
    return (
        F.when(is_object, result(F.coalesce(~false, F.lit(True)), told))
        .when(begins("true"), result(F.lit(True), start)).when(begins("false"), result(F.lit(False), start))
        .otherwise(result(F.lit(False), F.lit("unparseable QC response")))
    )


def first_n(rows: DataFrame, n: Column, by: str = "scene", order: str = "ord", width: int = 65_536) -> DataFrame:
    """The first n rows of each group, by an integer order. Each bucket of the order gives its first n, and the running
    sum is taken of these alone."""
    bucket = F.floor(F.col(order) / width)
    near = rows.withColumn("_n", F.row_number().over(W.partitionBy(by, bucket).orderBy(order))).where(F.col("_n") <= n).drop("_n")
    out = running_sum(near, [by], bucket, [order], F.lit(1), "_n")
    return out.where(F.col("_n") <= n).drop("_n")


def first_passing(rows: DataFrame, passed: Column, n: Column, by: str = "scene", order: str = "ord", width: int = 65_536) -> DataFrame:
    """The first n passing rows of each group (kept = true), and the failing ones before the n-th pass."""
    out = running_sum(rows.withColumn("kept", passed), [by], F.floor(F.col(order) / width), [order], F.col("kept").cast("int"), "_sum")
    return out.where(F.when(F.col("kept"), F.col("_sum") <= n).otherwise(F.col("_sum") < n)).drop("_sum")


def numbered(rows: DataFrame, key: str = "id", order: str = "ord", width: int = 65_536) -> DataFrame:
    """Rows without an id get their place in the order (an integer, see ``files.with_order``), from 1."""
    out = running_sum(rows.withColumn("_all", F.lit(0)), ["_all"], F.floor(F.col(order) / width), [order], F.lit(1), "_place")
    return out.withColumn(key, F.coalesce(key, "_place")).drop("_all", "_place")


def quota(total: int | Column, share: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(share * total).cast("int"))


def quotas(scenes: DataFrame, total: int, target: dict[str, float] = SCENES) -> DataFrame:
    """Adds share and target, the number of records wanted, to rows with a scene; a scene without a share of its own
    gets ``DEFAULT_SHARE``."""
    dim = scenes.sparkSession.createDataFrame(sorted(target.items()), "scene string, share double")
    share = F.coalesce("share", F.lit(DEFAULT_SHARE))
    return scenes.join(F.broadcast(dim), "scene", "left").withColumn("share", share).withColumn("target", quota(total, F.col("share")))


def distribution(rows: DataFrame, scene: Column, language: Column, is_fragment: Column) -> DataFrame:
    """Counts over all rows and by each of the three alone: (kind, value, n). A missing scene or language counts as
    unknown, a missing fragment mark as False; marks are written True and False."""
    mark = F.when(F.coalesce(is_fragment, F.lit(False)), "True").otherwise("False")
    named = {"scene": F.coalesce(scene, F.lit("unknown")), "language": F.coalesce(language, F.lit("unknown")), "is_fragment": mark}
    parts = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("value")) for k, c in {"total": F.lit(""), **named}.items()])
    return rows.select(F.explode(parts).alias("x")).groupBy("x.kind", "x.value").agg(F.count(F.lit(1)).alias("n"))


def drift(counts: DataFrame, target: dict[str, float], tolerance: float = 0.05) -> DataFrame:
    """Groups (scene, n) whose share is further from its target than the tolerance; missing groups count 0."""
    dim = counts.sparkSession.createDataFrame(sorted(target.items()), "scene string, target double")
    total = counts.agg(F.sum("n").alias("total"))
    joined = F.broadcast(dim).join(counts, "scene", "left").crossJoin(F.broadcast(total))
    actual = F.coalesce(F.col("n"), F.lit(0)) / F.greatest(F.coalesce("total", F.lit(0)), F.lit(1))
    return joined.select("scene", "target", actual.alias("actual")).where(F.abs(F.col("actual") - F.col("target")) > tolerance)


# --- sampling and export ---


def draw(key: Column, share: float, seed: int = 42) -> Column:
    """True for a fixed, seeded share of keys; the same in any engine that has MD5."""
    part = F.conv(F.left(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), F.lit(8)), 16, 10).cast("long")
    return part < int(share * 2**32)


def seeded(key: Column, seed: int = 42) -> Column:
    """A value whose order is a seeded shuffle."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


# Names of correction structures and of oral levels.
CORRECTIONS = ("none", "single", "rollback", "multiple")
LEVELS = ("low", "moderate", "high")


def controls(key: Column, scene: Column, seed: int = 42) -> Column:
    """What an oral text should contain: passthrough for 8 in 100, else one correction and one oral level."""

    def pick(salt: str, names: tuple[str, ...]) -> Column:
        digits = F.left(F.md5(F.concat_ws(":", F.lit(salt + str(seed)), key.cast("string"))), F.lit(8))
        place = F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(len(names))) + 1
        return F.element_at(F.array(*map(F.lit, names)), place.cast("int"))

    none = F.struct(F.lit("passthrough").alias("correction"), F.lit("passthrough").alias("level"), F.lit(False).alias("explain"))
    drawn = F.struct(pick("c", CORRECTIONS).alias("correction"), pick("l", LEVELS).alias("level"), (scene == "explanation").alias("explain"))
    return F.when(draw(key, 0.08, seed), none).otherwise(drawn)


def seed_blocks(seeds: DataFrame, count: int, block: int = 5, seed: int = 42, by: str = "scene") -> DataFrame:
    """``count`` blocks of each scene, each of ``block`` seeds drawn without replacement: seeds are shuffled anew
    in every cycle, and a tail shorter than a block is left out."""
    sizes = seeds.groupBy(by).agg(F.count(F.lit(1)).alias("_size")).withColumn("_per", F.floor(F.col("_size") / block))
    cycles = sizes.where(F.col("_per") > 0).withColumn("_cycle", F.explode(F.sequence(F.lit(0), F.ceil(F.lit(count) / F.col("_per")).cast("int") - 1)))
    rows = seeds.join(cycles, by)
    place = F.row_number().over(W.partitionBy(by, "_cycle").orderBy(seeded(F.concat_ws(":", F.col("_cycle"), F.col("seed")), seed), "seed"))
    rows = rows.withColumn("_block", F.floor((place - 1) / block)).where(F.col("_block") < F.col("_per"))
    return rows.withColumn("block", F.col("_cycle") * F.col("_per") + F.col("_block")).where(F.col("block") < count).groupBy(by, "block").agg(F.array_sort(F.collect_list("seed")).alias("seeds"))


def rounds(have: Column, want: Column, size: int) -> Column:
    """How many rounds of a size are still to run."""
    return F.greatest(F.lit(0), F.ceil((want - have) / size)).cast("int")


def split(rows: DataFrame, key: Column, strata: list[Column], share: float = 0.15, seed: int = 42) -> DataFrame:
    """Adds part, val or train. Each stratum gives floor(n * share) rows to val, and one if it has 5 or more;
    without strata, all rows are one and give floor(n * share). Rows are ranked by a seeded hash, whose first
    digits spread a large stratum over many tasks."""
    rows = rows.withColumn("_h", seeded(key, seed)).withColumn("_k", key)
    names = [f"_s{i}" for i in range(len(strata) or 1)]
    for name, c in zip(names, strata or [F.lit(0)]):
        rows = rows.withColumn(name, c)
    out = running_sum(rows, names, F.left("_h", F.lit(3)), ["_h", "_k"], F.lit(1), "_n", "_all")
    take = F.floor(F.col("_all") * F.lit(share))
    if strata:
        take = F.when((F.col("_all") >= 5) & (take == 0), 1).otherwise(take)
    return out.withColumn("part", F.when(F.col("_n") <= take, "val").otherwise("train")).drop("_h", "_k", "_n", "_all", *names)


def share_gpt(source: Column, refined: Column, system: str | None = None) -> Column:
    """An array of (from, value) turns; null if a side is empty."""
    turn = lambda who, what: F.struct(F.lit(who).alias("from"), what.alias("value"))
    turns = [*([turn("system", F.lit(system))] if system else []), turn("human", source), turn("gpt", refined)]
    return F.when((F.coalesce(source, F.lit("")) != "") & (F.coalesce(refined, F.lit("")) != ""), F.array(*turns))


def strata(scene: Column, refined: Column) -> list[Column]:
    return [scene, length_bucket(refined)]


#: What names a structured seed in a hint.
HINT_FIELDS = ("name", "artist")


def seed_name(seed: Column, width: int = 20) -> Column:
    """How a hint names a seed: a structured one by its name or else its artist, whole; another by its beginning."""
    own = [F.get_json_object(seed, f"$.{k}") for k in HINT_FIELDS]
    is_object = F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json(seed)), F.lit("OBJECT")), F.lit(False))
    return F.when(is_object, F.coalesce(*own, F.left(seed, F.lit(width)))).otherwise(F.left(seed, F.lit(width)))


def exclusion_hint(seeds: DataFrame, by: str = "scene", category: str = "category", order: str = "ord", seed: str = "seed", per: int = 5, most: int = 30) -> DataFrame:
    """(by, hint): for each of the first ``most`` categories that have any seed, a line with the names of its first
    ``per``, not to repeat. ``order`` is an integer; categories come in the order of their first seed, then by name. Only the names of the first seeds are
    gathered."""
    named = seeds.where(F.col(seed).isNotNull()).select(F.col(by).alias("_by"), F.col(category).alias("_c"), F.struct(by, category).alias("_g"), F.col(order).alias("_o"), seed_name(F.col(seed)).alias("_name"))
    few = first_n(named, F.lit(per), "_g", "_o")
    one = F.transform(F.array_sort(F.collect_list(F.struct("_o", "_name"))), lambda x: x["_name"])
    lines = few.groupBy("_by", "_c").agg(F.min("_o").alias("_o"), F.concat(F.col("_c"), F.lit(": "), F.array_join(one, ", "), F.lit("...")).alias("line"))
    top = F.slice(F.array_sort(F.collect_list(F.struct("_o", "_c", "line"))), 1, most)
    return lines.groupBy(F.col("_by").alias(by)).agg(F.array_join(F.transform(top, lambda x: x["line"]), "\n").alias("hint"))


def seed_list(words: Column, key: Column, most: int = 30, seed: int = 42, default: str = "Use appropriate scene-specific content.") -> Column:
    """Up to ``most`` different words in a seeded order, as one text for a prompt."""
    mixed = F.array_sort(F.transform(F.array_distinct(words), lambda w: F.struct(seeded(F.concat_ws(":", key.cast("string"), w), seed).alias("h"), w.alias("w"))))
    return F.when(F.size(words) > 0, F.array_join(F.transform(F.slice(mixed, 1, most), lambda x: x["w"]), ", ")).otherwise(F.lit(default))


def seed_rounds(pool: DataFrame, target: int = 3000, per_round: int = 200, by: str = "scene") -> DataFrame:
    """(by, have, rounds): how many different seeds (see ``dedup.dedup_seeds``) a pool holds in its list categories, and
    the rounds still to run."""
    have = pool.groupBy(by).agg(F.count(F.lit(1)).alias("have"))
    return have.withColumn("rounds", rounds(F.col("have"), F.lit(target), per_round))
