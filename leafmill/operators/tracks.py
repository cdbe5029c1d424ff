"""Caption tracks: which one to read, and which languages to offer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.operators.language import normalize_language
from leafmill.operators.ordered import first_per_key


def base(code: Column | str) -> Column:
    return F.coalesce(normalize_language(code), F.lit(""))


def original_audio(audio: DataFrame) -> DataFrame:
    """The spoken language of each video: among tracks that are not dubs the one labelled original, then the default."""
    real = audio.filter("NOT is_dubbed AND id IS NOT NULL AND id <> ''").withColumns({
        "_other": ~F.lower(F.coalesce("display_name", F.lit(""))).endswith("original"), "_rest": ~F.coalesce("is_default", F.lit(False)),
    })
    best = first_per_key(real, ["video_id"], [F.col("_other"), F.col("_rest"), F.col("track_no")])
    return best.select("video_id", F.split_part("id", F.lit("."), F.lit(1)).alias("original"))


def dubbed_languages(audio: DataFrame) -> DataFrame:
    dubs = audio.filter("is_dubbed AND id IS NOT NULL AND id <> ''")
    return dubs.select("video_id", base(F.split_part("id", F.lit("."), F.lit(1))).alias("language")).distinct()


def with_original(tracks: DataFrame, audio: DataFrame) -> DataFrame:
    """``original`` per track row: the audio's language, else that of a lone automatic track."""
    lone = tracks.filter("kind = 'asr'").groupBy("video_id").agg(
        F.when(F.count("*") == 1, F.max("language_code")).alias("_lone")
    )
    joined = tracks.drop("original").join(original_audio(audio), "video_id", "left").join(lone, "video_id", "left")
    return joined.withColumn("original", F.coalesce("original", "_lone")).drop("_lone")


def automatic_candidates(tracks: DataFrame, preferred: list[str]) -> DataFrame:
    """Automatic tracks are candidates only in the spoken and the preferred languages; added ones always are."""
    wanted = F.array(*[base(F.lit(p)) for p in preferred], base("original"), base("wanted"))
    language = base("language_code")
    return tracks.filter((F.col("kind") != "asr") | ((language != "") & F.array_contains(wanted, language)))


def pick_track(tracks: DataFrame, preferred: list[str]) -> DataFrame:
    """The track to read per video.

    With a wanted language: an added track in it, else an automatic one, else none. Otherwise the
    spoken language, then each preferred one, added before automatic; then any automatic, any added.
    """
    code, automatic = F.col("language_code"), F.col("kind") == "asr"

    def fits(language: Column) -> Column:
        return (code == language) | (base(code) == base(language))

    side = F.when(automatic, 1).otherwise(0)
    asked = F.coalesce("wanted", F.lit("")) != ""
    spoken = F.when(base("original") != "", fits(base("original")))
    rank = F.when(asked, F.when(fits(F.col("wanted")), side)).when(F.coalesce(spoken, F.lit(False)), side)
    for place, language in enumerate(preferred):
        rank = rank.when(fits(F.lit(language)), 10 + place + F.when(automatic, 50).otherwise(0))
    rank = rank.otherwise(F.when(automatic, 200).otherwise(300))
    ranked = tracks.withColumn("_rank", rank).filter("_rank IS NOT NULL")
    best = first_per_key(ranked, ["video_id"], [F.col("_rank"), F.col("track_no")])
    return best.select("video_id", "language_code", "kind")


def track_options(tracks: DataFrame, default: DataFrame, dubbed: DataFrame) -> DataFrame:
    """The languages a video can be read in, the default first, one row each; none unless there are several.

    ``tracks`` with ``original``; ``default(video_id, language_code)``; ``dubbed(video_id, language)``.
    """
    first = default.select("video_id", "language_code", F.lit(0).alias("_group"), F.lit(0).cast("bigint").alias("track_no"))
    manual = tracks.filter("kind <> 'asr'").select("video_id", "language_code", F.lit(1).alias("_group"), "track_no")
    hand = manual.select("video_id", base("language_code").alias("language")).distinct()
    dubs = dubbed.join(hand, ["video_id", "language"], "left_anti").select("video_id", "language", F.lit(True).alias("_dub"))
    automatic = tracks.filter("kind = 'asr'").withColumn("language", base("language_code"))
    spoken_dub = automatic.join(dubs, ["video_id", "language"], "left_semi").select(
        "video_id", "language_code", F.lit(2).alias("_group"), "track_no"
    )
    rows = first.unionByName(manual).unionByName(spoken_dub).withColumn("language", base("language_code")).filter("language <> ''")
    unique = rows.groupBy("video_id", "language").agg(F.min(F.struct("_group", "track_no")).alias("_at"))
    originals = tracks.groupBy("video_id").agg(base(F.max("original")).alias("_original"))
    joined = unique.join(originals, "video_id", "left").join(dubs, ["video_id", "language"], "left")
    spoken = F.coalesce("_original", F.lit(""))
    relation = (
        F.when((spoken != "") & (F.col("language") == spoken), "original").when(F.col("_dub"), "dubbed")
        .when(spoken != "", "translation")
    )
    several = joined.groupBy("video_id").agg((F.count("*") > 1).alias("_several"))
    # A video offers a handful of languages.
    offered = joined.join(several.filter("_several"), "video_id", "left_semi")
    return offered.select("video_id", "language", relation.alias("relation"), (F.col("_at._group") == 0).alias("is_default"))
