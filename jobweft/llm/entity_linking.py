"""Variant spellings of organisation names linked, by a prefix-filtered set-similarity join on token q-grams.

Each row gives the proper words of its name and the label of its own web domain. Words are joined to
words, and labels to labels and to names written together, that are as near as they have to be: by forms
that lack one character, or by as many disjoint q-grams as edits cannot all break. A name asks by its words,
each for what is so near that a name that holds nothing of it cannot reach the similarity. Names that meet are
verified by a soft similarity of their weighted words, where rare words count more, labels by edits. Links
are closed to groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweft.llm.canonical import folded, one_edit, shortened, tokens
from jobweft.llm.components import components
from jobweft.session import checkpointed

# Words of legal forms and such, which tell nothing about who is meant.
LEGAL = "inc incorporated ltd limited gmbh mbh ag sa sas sarl srl spa bv nv ab oy as kg ug llc llp plc pty corp corporation co company holding holdings group grp the and und et y e plus kk".split()
# Lines of business, with their usual abbreviations.
BUSINESS = {
    "engineering": "eng engr engrg", "manufacturing": "mfg mfr manuf", "robotics": "robo", "construction": "constr const bau", "pharmaceuticals": "pharma pharm pharmaceutical",
    "financial": "fin finance", "systems": "sys system", "technologies": "tech technology", "software": "sw soft", "laboratories": "labs lab laboratory",
    "education": "edu educ", "consulting": "cons consult consultants", "health": "hlth healthcare", "services": "svcs svc service serv", "energy": "nrg enrgy", "associates": "assoc assocs",
    "logistics": "log logist", "insurance": "ins insur", "foods": "fds food", "hospitality": "hosp", "dental": "dent dntl", "media": "", "retail": "", "solutions": "sol",
    "partners": "", "international": "intl int", "industries": "ind",
}
# First labels of a host that name no organisation, and endings of a label that only say what the site is.
SUBDOMAINS = "www careers career jobs job apply work recruiting hire talent".split()
SITE_ENDINGS = "careers|career|jobs|group|hq|hiring|team|talent|work"


def _cost(a: Column, b: Column) -> Column:
    """Edits between two words; two neighbours swapped count once."""
    return F.when(a == b, 0).when((F.length(a) == F.length(b)) & (F.levenshtein(a, b, 2) == 2) & one_edit(a, b), 1).otherwise(F.levenshtein(a, b))


def _sim(a: Column, b: Column) -> Column:
    return 1 - _cost(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def own_label(domain: Column, shared_hosts: str) -> Column:
    """The label of a domain that names its owner, without marks; null for shared hosts and labels that only end in careers and the like."""
    host = F.regexp_replace(F.regexp_replace(F.lower(F.trim(domain)), r"^[a-z]+://", ""), r"[/:?#].*$", "")
    host = F.regexp_replace(host, rf"^(?:(?:{'|'.join(SUBDOMAINS)})\.)+", "")
    label = F.regexp_extract(host, r"^([^.]+)\.[^.]+", 1)
    plain = F.regexp_replace(label, r"[^\p{L}\p{N}]", "")
    return F.when(~F.lower(domain).rlike(shared_hosts) & (plain != "") & ~plain.rlike(rf"(?:{SITE_ENDINGS})$"), plain)


def read_names(df: DataFrame, key: str, name: str, domain: str, shared_hosts: str) -> DataFrame:
    """(_id, core, line, label): proper words, line of business and own label; rows without a name are left out."""
    lines = {w: full for full, short in BUSINESS.items() for w in [full, *short.split()]}
    table = F.create_map(*[F.lit(x) for k, v in lines.items() for x in (k, v)])
    long_lines = F.array(*[F.lit(k) for k in BUSINESS if len(k) >= 5])
    # S.A. is one word, and the capitals of GmbH begin none
    text = F.regexp_replace(F.regexp_replace(F.col(name), r"\b(\p{L})\.\s?(?=\p{L}\.)", "$1"), "(?i)gmbh", "gmbh")
    d = df.where(F.col(key).isNotNull() & F.col(name).rlike(r"[\p{L}\p{N}]")).select(
        F.col(key).alias("_id"), tokens(F.regexp_replace(folded(text), "['’]", "")).alias("_t"), own_label(F.col(domain), shared_hosts).alias("_label"))
    # a misspelt line of business is one edit from its word, or two from a long one
    near = lambda w, t: (F.abs(F.length(w) - F.length(t)) <= 1) & (one_edit(w, t) | ((F.length(t) >= 8) & (F.levenshtein(w, t) <= 2)))
    line_of = lambda t: F.coalesce(table[t], F.when(F.length(t) >= 5, F.get(F.filter(long_lines, lambda w: near(w, t)), F.lit(0))))
    legal, long_legal = F.array(*[F.lit(w) for w in LEGAL]), F.array(*[F.lit(w) for w in LEGAL if len(w) >= 5])
    told = F.filter("_t", lambda t: ~F.array_contains(legal, t) & ~((F.length(t) >= 4) & F.exists(long_legal, lambda w: one_edit(w, t))))
    d = d.withColumn("_t", F.transform(told, lambda t: F.struct(t.alias("t"), line_of(t).alias("line"), table[t].alias("sure"))))
    # a proper word may look like a misspelt line: where another word names a line surely, two proper words must be left
    proper, sure = F.filter("_t", lambda x: x["line"].isNull()), F.filter("_t", lambda x: x["sure"].isNull())
    core = F.transform(F.when((F.size(proper) < 2) & F.exists("_t", lambda x: x["sure"].isNotNull()), sure).otherwise(proper), lambda x: x["t"])
    line = F.coalesce(F.get(F.filter("_t", lambda x: x["sure"].isNotNull()), F.lit(0))["sure"], F.get(F.filter("_t", lambda x: x["line"].isNotNull()), F.lit(0))["line"])
    endings = "|".join(sorted((k for k in BUSINESS), key=len, reverse=True))
    return d.select("_id", core.alias("core"), line.alias("line"), F.regexp_replace("_label", rf"(?<=.{{6}})(?:{endings})+$", "").alias("label"))


def like_strings(index: DataFrame, asking: DataFrame, longest: int = 64) -> DataFrame:
    """(kind, text, near, other), distinct: strings ``other`` of ``index`` (kind, text) that may be as near as ``near`` to a string of ``asking`` (kind, text, near): none that is gets lost.

    Strings of m and n characters are as near with at most k = max(m, n) (1 - near) edits. Without edits they
    are equal, and with one both have a form in common that lacks a character. For more, the other is cut into
    k + 1 disjoint q-grams, one of which is unbroken in the string; if it is the i-th, at most i edits lie
    before it and k - i behind, which says where. Lengths and places are part of the match. Strings of over
    ``longest`` characters, which are few, are met by their lengths alone.
    """
    edits = F.floor(F.greatest("m", "n") * (1 - F.col("near")) + 1e-9).cast("int")
    known = index.select("kind", F.col("text").alias("other"), F.length("text").alias("n"))
    asked = asking.select("kind", "text", "near", F.length("text").alias("m"))
    equal = asked.join(known.select("kind", "other", F.col("other").alias("text")), ["kind", "text"]).select("kind", "text", "near", "other")

    lengths = known.where(F.col("n") <= longest).select("kind", "n").distinct()
    sized = asked.join(F.broadcast(lengths), "kind").withColumn("k", edits).where("k >= 1 AND abs(n - m) <= k")
    lacking = lambda d, c: d.withColumn("form", F.explode(shortened(F.col(c))))
    single = sized.where("k = 1")
    one = lacking(single.select("kind", "text", "near").distinct(), "text").join(lacking(known.join(F.broadcast(single.select("kind", "n").distinct()), ["kind", "n"]), "other"), ["kind", "form"])
    one = one.where(F.col("text") != F.col("other")).where(_cost(F.col("text"), F.col("other")) == 1).select("kind", "text", "near", "other")

    several = sized.where("k >= 2")
    cut = lambda d: d.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k")))).withColumns({
        "at": F.floor(F.col("n") * F.col("i") / (F.col("k") + 1)).cast("int"), "end": F.floor(F.col("n") * (F.col("i") + 1) / (F.col("k") + 1)).cast("int")})
    grams = cut(known.join(F.broadcast(several.select("kind", "n", "k").distinct()), ["kind", "n"])).select("kind", "other", "n", "k", "i", F.substr("other", F.col("at") + 1, F.col("end") - F.col("at")).alias("gram"))
    # where there are more edits than characters, a q-gram is empty and stands at one place only
    places = cut(several).withColumns({"_lo": F.expr("greatest(0, at - i, at + m - n - k + i)"), "_hi": F.expr("least(m - end + at, at + i, at + m - n + k - i)")}).where("_lo <= _hi")
    places = places.withColumn("p", F.explode(F.sequence(F.col("_lo"), F.when(F.col("end") > F.col("at"), F.col("_hi")).otherwise(F.col("_lo")))))
    places = places.select("kind", "text", "near", "n", "k", "i", F.substr("text", F.col("p") + 1, F.col("end") - F.col("at")).alias("gram"))
    more = places.join(grams, ["kind", "n", "k", "i", "gram"]).where(F.col("text") != F.col("other")).where(F.expr("levenshtein(text, other, k) >= 0")).select("kind", "text", "near", "other")

    doubled = lambda c: F.floor(F.log2(c)).cast("int")
    vast = asked.where(F.col("m") >= F.floor(longest * F.col("near"))).withColumn("size", F.explode(F.sequence(doubled(F.greatest(F.col("m") * F.col("near") - 1, F.lit(1))), doubled(F.col("m") / F.col("near") + 1))))
    vast = vast.join(known.where(F.col("n") > longest).withColumn("size", doubled(F.col("n"))), ["kind", "size"]).withColumn("k", F.greatest(edits, F.lit(2)))
    vast = vast.where("abs(n - m) <= k AND text <> other").where(F.expr("levenshtein(text, other, k) >= 0")).select("kind", "text", "near", "other")
    return equal.unionByName(one).unionByName(more).unionByName(vast).distinct()


LINE_WEIGHT = 3.0
ROUNDING = 1e-9  # sums of weights that meet a threshold may miss it by this


def _covered(x: str, y: str) -> Column:
    """The share of the weight of name ``x`` that name ``y`` covers, words by their most similar, a line of business where both state one."""
    soft = F.aggregate(F.col(f"{x}_words"), F.lit(0.0), lambda s, w: s + w["idf"] * F.coalesce(F.array_max(F.transform(F.col(f"{y}_words"), lambda v: _sim(w["w"], v["w"]))), F.lit(0.0)))
    stated = F.col("a_line").isNotNull() & F.col("b_line").isNotNull()
    met = F.when(stated & (F.col("a_line") == F.col("b_line")), LINE_WEIGHT).otherwise(0.0)
    return F.coalesce(F.try_divide(soft + met, F.col(f"{x}_mass") + F.when(stated, LINE_WEIGHT).otherwise(0.0)), F.lit(0.0))


def _within(x: str, y: str) -> Column:
    """Whether name ``x`` may lose what the letters that ``y`` lacks cost at least: each is an edit of its word."""
    lacking = lambda w: F.bit_count(w["letters"].bitwiseAND(F.bitwise_not(F.col(f"{y}_letters")))) / F.greatest(F.length(w["w"]), F.col(f"{y}_longest"))
    return F.aggregate(F.col(f"{x}_words"), F.lit(0.0), lambda s, w: s + w["idf"] * lacking(w)) <= F.col(f"{x}_loss")


def _names() -> Column:
    return F.least(_covered("a", "b"), _covered("b", "a"))


def _side(facts: DataFrame, side: str, *cols: str) -> DataFrame:
    return facts.select(*[F.col(c).alias(f"{side}_{c}") for c in cols or facts.columns])


def weighed(profiles: DataFrame) -> DataFrame:
    """Profiles (pid, core, line, label) with their distinct words (w, idf, df, letters as bits), the weight of all, and the profiles that stand for their name and label."""
    full = F.filter("core", lambda t: F.length(t) >= 2)  # an initial is no name
    whole = F.size(full) >= 2
    name, line = F.sort_array("core"), F.coalesce("line", F.lit(""))
    # profiles of one name, however many, are linked through one of them, and only it is compared with others;
    # on a label each name has one of its own, as two names on it may be two organisations, and each order of words is written together
    by_name = profiles.where(whole).groupBy(name.alias("c"), line.alias("l")).agg(F.min("pid").alias("n_rep"))
    by_order = profiles.where(whole).groupBy(F.col("core").alias("_oc"), line.alias("_ol")).agg(F.min("pid").alias("s_rep"))
    by_label = profiles.where("label IS NOT NULL").groupBy(F.col("label").alias("_label"), name.alias("_lc"), line.alias("_ll")).agg(F.min("pid").alias("l_rep"))
    keyed = profiles.withColumns({"_c": name, "_l": line})
    keyed = keyed.join(by_name, (F.col("_c") == F.col("c")) & (F.col("_l") == F.col("l")) & whole, "left").join(by_order, (F.col("core") == F.col("_oc")) & (F.col("_l") == F.col("_ol")) & whole, "left").join(
        by_label, (F.col("label") == F.col("_label")) & (F.col("_c") == F.col("_lc")) & (F.col("_l") == F.col("_ll")), "left")
    total = profiles.agg(F.count(F.lit(1))).scalar()
    held = profiles.select("pid", F.explode("core").alias("w")).groupBy("pid", "w").agg(F.count(F.lit(1)).alias("n"))
    words = profiles.select(F.explode("core").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df")).withColumns({
        "idf": F.log1p(total / F.col("df")), "letters": F.expr("aggregate(split(w, ''), 0L, (s, c) -> s | shiftleft(1L, ascii(c) % 63))")})
    held = held.join(words, "w").groupBy("pid").agg(F.sort_array(F.collect_list(F.struct("w", (F.col("n") * F.col("idf")).alias("idf"), "df", "letters"))).alias("words"))
    words = F.coalesce("words", F.array().cast("array<struct<w:string,idf:double,df:bigint,letters:bigint>>"))
    return checkpointed(keyed.join(held, "pid", "left").select(
        "pid", "line", "label", "n_rep", "s_rep", "l_rep", whole.alias("whole"), F.array_join(full, "").alias("joined"), F.array_join(F.reverse(full), "").alias("turned"),
        words.alias("words"), F.aggregate(words, F.lit(0.0), lambda s, w: s + w["idf"]).alias("mass")))


def candidate_pairs(facts: DataFrame, accept: float, accept_label: float, hot: int = 500, least_near: float = 0.5) -> DataFrame:
    """(a, b), distinct, of weighed profiles: all that meet a threshold, by the profiles that stand for a name or label.

    A name that is met loses at most a certain weight. Asked words whose weights come to W cannot all be
    less near than 1 - loss / W, so each asks for the words as near as that. A name asks by all its words but
    those that over ``hot`` profiles hold, and by these too where the others would have to ask for less than ``least_near``.
    """
    # names: found by what each may lose, and compared where they meet
    loss = (1 - accept + ROUNDING) * (F.col("mass") + F.when(F.col("line").isNotNull(), LINE_WEIGHT).otherwise(0.0))
    named = facts.where("pid = n_rep").select("pid", "line", "words", "mass", loss.alias("loss"))
    rarest = F.array_sort(F.transform("words", lambda x: F.struct(x["df"].alias("df"), x["w"].alias("w"), x["idf"].alias("idf"))))
    taken = F.aggregate("_rarest", F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n")), lambda s, x: F.when(
        (x["df"] <= hot) | (s["sum"] < F.col("loss") / (1 - least_near)), F.struct((s["sum"] + x["idf"]).alias("sum"), (s["n"] + 1).alias("n"))).otherwise(s))
    named = named.withColumn("_rarest", rarest).withColumn("_taken", taken).withColumn("all", F.col("_taken.n") == F.size("words"))
    near = F.greatest(F.floor((1 - F.col("loss") / F.col("_taken.sum")) * 100) / 100, F.lit(0.001))
    named = named.withColumns({"letters": F.expr("aggregate(words, 0L, (s, x) -> s | x.letters)"), "longest": F.array_max(F.transform("words", lambda x: F.length(x["w"])))})
    cols = "pid", "line", "words", "mass", "loss", "letters", "longest", "all"
    asks = named.where("loss < mass").select(*cols, near.alias("near"), F.explode(F.slice("_rarest", F.lit(1), F.col("_taken.n"))).alias("_x")).withColumn("text", F.col("_x.w")).drop("_x")
    holders = named.select(*cols, F.explode("words.w").alias("other"))

    # labels: with like labels, and with names written together in either order
    on_label = facts.where("pid = l_rep").select("label", "pid")
    strings = facts.where("pid = s_rep").select("pid", F.explode(F.array_distinct(F.array("joined", "turned"))).alias("text")).unionByName(on_label.select("pid", F.col("label").alias("text")))
    index = holders.select(F.lit("word").alias("kind"), F.col("other").alias("text")).unionByName(on_label.select(F.lit("label").alias("kind"), F.col("label").alias("text"))).distinct()
    asking = asks.select(F.lit("word").alias("kind"), "text", "near").unionByName(strings.select(F.lit("label").alias("kind"), "text", F.lit(accept_label).alias("near"))).distinct()
    met = checkpointed(like_strings(checkpointed(index), checkpointed(asking)))

    asked = asks.join(met.where("kind = 'word'").drop("kind"), ["text", "near"])
    by_words = _side(asked, "a", *cols, "other").join(_side(holders, "b", *cols, "other"), F.col("a_other") == F.col("b_other"))
    # of two names that both ask by all their words one finds the other
    by_words = by_words.where("a_pid <> b_pid AND (a_pid < b_pid OR NOT a_all OR NOT b_all)").where(_within("a", "b")).where(_within("b", "a"))
    by_words = by_words.where(_covered("a", "b") >= accept - ROUNDING).where(_covered("b", "a") >= accept - ROUNDING).select(F.col("a_pid").alias("pa"), F.col("b_pid").alias("pb"))
    by_label = strings.select(F.col("pid").alias("pa"), "text").join(met.where("kind = 'label'"), "text").join(on_label.select(F.col("pid").alias("pb"), F.col("label").alias("other")), "other").select("pa", "pb")
    # names of hardly any weight are told by their line alone
    light = named.where("loss >= mass AND line IS NOT NULL").select("pid", "line")
    by_line = light.join(light.groupBy("line").agg(F.min("pid").alias("pb")), "line").select(F.col("pid").alias("pa"), "pb")
    stars = facts.select(F.col("pid").alias("pa"), F.explode(F.array_compact(F.array("n_rep", "s_rep", "l_rep"))).alias("pb"))
    near_pairs = by_words.unionByName(by_label).unionByName(by_line).unionByName(stars).where("pa <> pb")
    return near_pairs.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()


def accepted_pairs(facts: DataFrame, candidates: DataFrame, accept: float, accept_label: float) -> DataFrame:
    """(a, b) of the candidates that mean the same organisation."""
    cols = "pid", "line", "label", "whole", "joined", "turned", "words", "mass"
    pairs = candidates.join(_side(facts, "a", *cols), F.col("a") == F.col("a_pid")).join(_side(facts, "b", *cols), F.col("b") == F.col("b_pid")).withColumn("names", _names())
    names, accept, accept_label = F.col("names"), accept - ROUNDING, accept_label - ROUNDING
    name_match = F.col("a_whole") & F.col("b_whole") & (names >= accept)
    label_match = F.coalesce(_sim(F.col("a_label"), F.col("b_label")) >= accept_label, F.lit(False))
    across = lambda x, y: F.col(f"{x}_whole") & F.coalesce(F.greatest(_sim(F.col(f"{x}_joined"), F.col(f"{y}_label")), _sim(F.col(f"{x}_turned"), F.col(f"{y}_label"))) >= accept_label, F.lit(False))
    # two whole names that differ are two organisations, whatever their labels have in common
    contradict = F.col("a_whole") & F.col("b_whole") & (names < 0.6 - ROUNDING)
    # a short name that shares a word with a full one is not linked to others of the label with which it shares none
    fits = F.exists("a_words", lambda x: (F.length(x["w"]) >= 2) & F.exists("b_words", lambda y: _sim(x["w"], y["w"]) >= 0.75))
    linked = checkpointed(pairs.where(name_match | ((label_match | across("a", "b") | across("b", "a")) & ~contradict)).select("a", "b", "a_whole", "b_whole", F.coalesce(fits, F.lit(False)).alias("fits")))
    fitted = linked.where("a_whole <> b_whole AND fits").select(F.when(F.col("a_whole"), F.col("b")).otherwise(F.col("a")).alias("short")).distinct()
    linked = linked.join(fitted.select(F.col("short").alias("a"), F.lit(True).alias("a_fitted")), "a", "left").join(fitted.select(F.col("short").alias("b"), F.lit(True).alias("b_fitted")), "b", "left")
    free = F.col("fits") | (F.col("a_whole") & F.col("b_whole")) | ~F.coalesce(F.when(F.col("a_whole"), F.col("b_fitted")).when(F.col("b_whole"), F.col("a_fitted")).otherwise(F.col("a_fitted") & F.col("b_fitted")), F.lit(False))
    return linked.where(free).select("a", "b")


def linked_pairs(profiles: DataFrame, *, accept: float = 0.8, accept_label: float = 0.81) -> DataFrame:
    """(a, b) of profiles (pid, core, line, label) that mean the same organisation; profiles of one name or label may be linked through one of them."""
    facts = weighed(profiles)
    return accepted_pairs(facts, candidate_pairs(facts, accept, accept_label), accept, accept_label)


def link_names(
    df: DataFrame, *, key: str = "id", name: str = "company_name", domain: str = "domain", shared_hosts: str = r"(?:^|\.)jobs\.example$",
) -> DataFrame:
    """Rows (id, group_id): rows with one group_id stand for the same organisation; group_id is the least id of the group.

    Rows without a name, or with one of marks only, and null keys are left out. Rows that agree in their
    proper words, line of business and own domain label are one profile before anything is compared, so
    copies cost nothing and a repeated row changes nothing. A short name, an initial or an acronym links
    by the row's own domain only; a shared board host (``shared_hosts``, a pattern on the host) or one
    word in common links nothing. Domains may be null. Very long names are compared whole. An empty
    table gives no rows. Other columns are not read.
    """
    rows = checkpointed(read_names(df, key, name, domain, shared_hosts).distinct().withColumn("pid", F.xxhash64("core", F.coalesce("line", F.lit("")), F.coalesce("label", F.lit("")))))
    # a short name without a domain of its own says too little to join even its equals
    known = F.size(F.filter("core", lambda t: F.length(t) >= 2)) >= 2
    rows = rows.withColumn("pid", F.when(known | F.col("label").isNotNull(), F.col("pid")).otherwise(F.xxhash64(F.lit("alone"), "_id")))
    profiles = rows.groupBy("pid").agg(F.first("core").alias("core"), F.first("line").alias("line"), F.first("label").alias("label"))
    links = linked_pairs(profiles)
    joined = components(links, "a", "b").withColumnRenamed("node", "pid")
    members = rows.select("_id", "pid").join(joined, "pid", "left").select(F.col("_id").alias("id"), F.coalesce("component", "pid").alias("_c"))
    least = members.groupBy("_c").agg(F.min("id").alias("group_id"))
    return members.join(least, "_c").select("id", "group_id").distinct()


def same_entity_pairs(df: DataFrame, **settings) -> DataFrame:
    """All pairs (id_a, id_b), smaller first, of rows of one group of link_names."""
    groups = checkpointed(link_names(df, **settings))
    return groups.select(F.col("id").alias("id_a"), "group_id").join(groups.select(F.col("id").alias("id_b"), "group_id"), "group_id").where("id_a < id_b").select("id_a", "id_b").distinct()
