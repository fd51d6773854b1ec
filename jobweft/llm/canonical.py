"""Free-entered values mapped to the closest entry of a reference list, by token repair and soft TF-IDF.

Distinct values are cut into tokens. Each distinct token that the reference vocabulary lacks is joined
to it by edit distance, through the variants that lack one character. An entry is a candidate where one
of its phrases (its own words, a synonym, a city) stands in the repaired tokens, and candidates are
ranked by rule order first, then by the weight of all their tokens that the value holds, rare ones
counting more.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobweft.session import checkpointed

# Synonyms of the employment types and workplace types; order of types where several meet.
EMPLOYMENT = {
    "Full-time": "temps plein, full time, ft, permanent, regular, tiempo completo, jornada completa, vollzeit, festanstellung, tempo pieno, voltijd",
    "Part-time": "temps partiel, part time, pt, moonlight, moonlighter, medio tiempo, tiempo parcial, media jornada, teilzeit, minijob, deeltijd",
    "Contract": "contract, contractor, contracted, freelance, freelancer, 1099, consultant, b2b, c2c, corp to corp, contrato, freiberuflich, freie mitarbeit, prestataire, autonomo",
    "Internship": "intern, internship, stagiaire, stage, practicante, practicas, praktikum, praktikant, becario, placement, pasantia",
    "Temporary": "temp, temporary, seasonal, fixed term, interim, interimaire, casual, prn, per diem, befristet, zeitarbeit, aushilfe, temporar, temporaire, saisonnier, eventual, temporal",
    "Volunteer": "volunteer, volunteering, voluntario, benevole, benevolat, ehrenamt, ehrenamtlich",
}
EMPLOYMENT_ORDER = ("Internship", "Volunteer", "Temporary", "Contract", "Part-time", "Full-time")
WORKPLACE = {
    "Hybrid": "hybrid, hibrido, hybride, partially remote, partly remote, flex office, teilweise remote",
    "Remote": "remote, remoto, work from home, working from home, work from anywhere, wfh, telecommute, telecommuting, telework, teletravail, teletrabajo, a distance, home office, home based, fernarbeit",
    "Onsite": "on site, in office, in the office, office, in person, on premise, on premises, presencial, presentiel, vor ort, sur site, sur place, not remote, no remote",
}
WORKPLACE_ORDER = ("Hybrid", "Remote", "Onsite")
NEGATED = ("not remote", "no remote")
# Abbreviations of the first word of a place name.
PLACE_WORDS = {"st": "saint", "ste": "saint", "mt": "mount", "mtn": "mountain", "pt": "port", "ft": "fort"}

ACCENTED = "".join(chr(c) for c in range(0xC0, 0x250) if unicodedata.normalize("NFD", chr(c))[0] < "\x80")
PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in ACCENTED)


def folded(text: Column) -> Column:
    """Words apart at case changes and marks, lower case, without accents."""
    text = F.regexp_replace(text, "&amp;", "&")
    text = F.regexp_replace(text, r"(?<=\p{Ll})(?=\p{Lu})", " ")
    text = F.regexp_replace(F.translate(text, ACCENTED, PLAIN), r"[̀-ͯ]", "")
    return F.translate(F.regexp_replace(F.lower(text), "ß", "ss"), "øœæłđ", "ooald")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), 0)


def country_names(spark: SparkSession) -> DataFrame:
    """(phrase, code): the English, German, French and Spanish names of all countries, as the Java runtime knows them."""
    locale = spark._jvm.java.util.Locale
    rows = set()
    for code in locale.getISOCountries():
        for lang in ("en", "de", "fr", "es"):
            rows.add((locale("", code).getDisplayCountry(locale(lang)), code.lower()))
        rows.add((locale("", code).getISO3Country(), code.lower()))
    rows |= {("USA", "us"), ("U.S.A.", "us"), ("U.S.", "us"), ("United States of America", "us"), ("UK", "gb"), ("U.K.", "gb"), ("Great Britain", "gb"), ("England", "gb"), ("Scotland", "gb"), ("Holland", "nl")}
    return spark.createDataFrame(sorted(rows), "name string, code string").select(F.array_join(tokens(folded(F.col("name"))), " ").alias("phrase"), "code").where("phrase <> ''").distinct()


def one_edit(a: Column, b: Column) -> Column:
    """Equal but for one character more, less or other, or two neighbours swapped."""
    swapped = F.exists(F.sequence(F.lit(1), F.length(a) - 1), lambda i: F.concat(
        F.substr(a, F.lit(1), i - 1), F.substr(a, i + 1, F.lit(1)), F.substr(a, i, F.lit(1)), F.substr(a, i + 2)) == b)
    return (F.levenshtein(a, b) <= 1) | ((F.length(a) == F.length(b)) & (F.length(a) > 1) & swapped)


def shortened(c: Column) -> Column:
    """The token and all its forms that lack one character."""
    return F.array_distinct(F.concat(F.array(c), F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substr(c, F.lit(1), i - 1), F.substr(c, i + 1)))))


def repair(found: DataFrame, vocabulary: DataFrame, *, shortest: int = 4, shortest_synonym: int = 6) -> DataFrame:
    """(field_name, token, meant, sim) for tokens of the data: those of the vocabulary mean themselves, others what is one edit away.

    Vocabulary words under ``shortest`` characters (``shortest_synonym`` for those that no entry itself
    holds), and anything with a digit, are met exactly only.
    """
    exact = found.join(vocabulary, ["field_name", "token"]).select("field_name", "token", F.col("token").alias("meant"), F.lit(1.0).alias("sim"))
    unknown = found.join(vocabulary, ["field_name", "token"], "left_anti").where((F.length("token") >= shortest - 1) & ~F.col("token").rlike(r"\d"))
    left = unknown.select("field_name", "token", F.explode(shortened(F.col("token"))).alias("_form"))
    known = vocabulary.where((F.length("token") >= F.when(F.col("own"), shortest).otherwise(shortest_synonym)) & ~F.col("token").rlike(r"\d"))
    right = known.select("field_name", F.col("token").alias("meant"), F.explode(shortened(F.col("token"))).alias("_form"))
    near = (
        left.join(right, ["field_name", "_form"]).select("field_name", "token", "meant").distinct().where(one_edit(F.col("token"), F.col("meant")))
        .select("field_name", "token", "meant", (1 - 1 / F.greatest(F.length("token"), F.length("meant"))).alias("sim"))
    )
    return exact.unionByName(near)


def reference_phrases(spark: SparkSession, canon: DataFrame, place_fields: Sequence[str], synonyms: Mapping[str, tuple[Mapping[str, str], Sequence[str]]]) -> DataFrame:
    """(field_name, canon_id, rank, phrase tokens): an entry's own words and synonyms, of places the city."""
    place = F.col("field_name").isin(*place_fields)
    own = canon.select("field_name", "canon_id", "entry", tokens(folded(F.when(place, F.element_at(F.split("entry", ","), 1)).otherwise(F.col("entry")))).alias("phrase"))
    rows = [
        (field, entry, 0 if phrase in NEGATED else order.index(entry) + 1, phrase.split())
        for field, (table, order) in synonyms.items() for entry, phrases in table.items() for phrase in phrases.split(", ")
    ]
    if not rows:
        return own.select("field_name", "canon_id", F.lit(1).alias("rank"), "phrase")
    extra = spark.createDataFrame(rows, "field_name string, entry string, rank int, phrase array<string>")
    ranks = spark.createDataFrame([(f, e, o.index(e) + 1) for f, (_, o) in synonyms.items() for e in o], "field_name string, entry string, rank int")
    named = own.join(ranks, ["field_name", "entry"], "left").select("field_name", "canon_id", F.coalesce("rank", F.lit(1)).alias("rank"), "phrase")
    named = named.unionByName(extra.join(canon, ["field_name", "entry"]).select("field_name", "canon_id", "rank", "phrase"))
    # words written together
    joined = named.where((F.size("phrase") > 1) & ~F.col("field_name").isin(*place_fields)).select("field_name", "canon_id", "rank", F.array(F.array_join("phrase", "")).alias("phrase"))
    return named.unionByName(joined).where(F.size("phrase") > 0).distinct()


def map_to_canonical(
    df: DataFrame,
    canon: DataFrame,
    fields: Sequence[str] = ("employment_type", "workplace_type", "location"),
    *,
    key: str = "id",
    place_fields: Sequence[str] = ("location",),
    synonyms: Mapping[str, tuple[Mapping[str, str], Sequence[str]]] | None = None,
) -> DataFrame:
    """Rows (key, field_name, canon_id), distinct: the entry meant by each value of the fields, 0 if none is.

    ``canon`` has (canon_id, field_name, entry); entries of ``place_fields`` read city, region, country
    code. Null and blank values and those that equal an entry of their field in every character give no
    row. A place matches by its city only, whatever stands around it; region and country choose between
    cities of one name, and where they don't the entry with the lowest canon_id is taken. A city name
    does not match behind a word that begins other names (Port, Saint). Between types the order given
    with ``synonyms`` decides, then weight, then the lowest canon_id. Repeated rows give one, rows with
    a null key none. Very long values are read whole. An empty list maps every value to 0.
    """
    spark = df.sparkSession
    if synonyms is None:
        synonyms = {"employment_type": (EMPLOYMENT, EMPLOYMENT_ORDER), "workplace_type": (WORKPLACE, WORKPLACE_ORDER)}
    canon = canon.where("canon_id IS NOT NULL AND entry IS NOT NULL").select("canon_id", "field_name", "entry").distinct()
    long = df.where(F.col(key).isNotNull()).select(F.col(key), F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields])).alias("_e"))
    long = long.select(key, "_e.field_name", "_e.value").where(F.col("value").rlike(r"[^\s ]"))
    long = long.join(canon.select("field_name", F.col("entry").alias("value")), ["field_name", "value"], "left_anti")
    # each table below is small beside the data and used several times, so it is kept
    values = checkpointed(long.select("field_name", "value").distinct().withColumn("_t", tokens(folded(F.col("value")))))
    place = F.col("field_name").isin(*place_fields)
    short = F.create_map(*[F.lit(x) for k, v in PLACE_WORDS.items() for x in (k, v)])
    # the words of a short value written together are one more token, apart from the others
    joined = F.when(~place & F.size("_t").between(2, 4), F.array(F.struct(F.lit(-9).alias("pos"), F.array_join("_t", "").alias("token")))).otherwise(
        F.array().cast("array<struct<pos:int,token:string>>"))
    spots = F.concat(F.transform("_t", lambda t, i: F.struct(i.cast("int").alias("pos"), F.when(place, F.coalesce(short[t], t)).otherwise(t).alias("token"))), joined)
    placed = values.select("field_name", "value", F.inline(spots))

    phrases = reference_phrases(spark, canon, place_fields, synonyms).withColumn("_phrase", F.array_join("phrase", " "))
    words = phrases.select("field_name", "canon_id", "rank", "_phrase", F.size("phrase").alias("_n"), F.posexplode("phrase").alias("_i", "meant"))
    words = checkpointed(words.withColumn("meant", F.when(place, F.coalesce(short[F.col("meant")], F.col("meant"))).otherwise(F.col("meant"))))
    # all tokens of an entry with their weights: of places region and country too
    whole = canon.select("field_name", "canon_id", F.explode(tokens(folded(F.col("entry")))).alias("meant"), F.lit(True).alias("_own"))
    entry_words = words.select("field_name", "canon_id", "meant", F.lit(False).alias("_own")).unionByName(whole).groupBy("field_name", "canon_id", "meant").agg(F.max("_own").alias("_own"))
    size = canon.groupBy("field_name").agg(F.count(F.lit(1)).alias("_all"))
    per_word = Window.partitionBy("field_name", "meant")  # entries of the reference list
    entry_words = checkpointed(entry_words.join(size, "field_name").withColumn("_idf", F.log1p(F.col("_all") / F.count(F.lit(1)).over(per_word))))
    vocabulary = entry_words.groupBy("field_name", F.col("meant").alias("token")).agg(F.max("_own").alias("own"))
    repaired = repair(placed.select("field_name", "token").distinct(), vocabulary)
    seen = checkpointed(placed.join(repaired, ["field_name", "token"]).select("field_name", "value", "pos", "meant", "sim"))

    hits = (
        seen.join(words, ["field_name", "meant"]).groupBy("field_name", "value", "canon_id", "rank", "_phrase", "_n", (F.col("pos") - F.col("_i")).alias("_start"))
        .agg(F.count_distinct("_i").alias("_met"), F.sum("sim").alias("_sum")).where("_met = _n")
    )
    openers = words.where(place & (F.col("_i") == 0) & (F.col("_n") > 1)).select("field_name", F.col("meant").alias("token")).distinct()
    led = placed.join(openers, ["field_name", "token"], "left_semi").select("field_name", "value", (F.col("pos") + 1).alias("_start"))
    hits = hits.join(led, ["field_name", "value", "_start"], "left_anti")
    candidates = hits.groupBy("field_name", "value", "canon_id").agg(F.min("rank").alias("rank"), F.max(F.col("_sum") / F.col("_n")).alias("_fit"))
    # the value's own country names as codes, and its region words, weigh the entries of one name
    grams = values.where(place & (F.size("_t") > 0)).select("field_name", "value", F.explode(F.flatten(F.transform(F.array(*[F.lit(n) for n in range(1, 5)]), lambda n: F.transform(
        F.filter(F.sequence(F.lit(1), F.size("_t")), lambda i: i + n - 1 <= F.size("_t")), lambda i: F.array_join(F.slice("_t", i, n), " "))))).alias("phrase"))
    codes = grams.join(country_names(spark), "phrase").select("field_name", "value", F.col("code").alias("meant"), F.lit(1.0).alias("sim"))
    evidence = seen.select("field_name", "value", "meant", "sim").unionByName(codes).groupBy("field_name", "value", "meant").agg(F.max("sim").alias("sim"))
    scores = (
        candidates.join(entry_words, ["field_name", "canon_id"]).join(evidence, ["field_name", "value", "meant"])
        .groupBy("field_name", "value", "canon_id", "rank", "_fit").agg(F.sum(F.col("sim") * F.col("_idf") ** 2).alias("_score"))
    )
    # the best of a value: least rank, then best fit, then greatest weight, then least canon_id
    best = scores.groupBy("field_name", "value").agg(F.min(F.struct("rank", -F.col("_fit"), -F.round("_score", 9), "canon_id")).alias("_best")).select("field_name", "value", "_best.canon_id")
    return long.join(best, ["field_name", "value"], "left").select(key, "field_name", F.coalesce("canon_id", F.lit(0)).cast("long").alias("canon_id")).distinct()
