"""Personal data: keyed, type-consistent surrogates (DataFrame functions only).

Detected: e-mail addresses, IPv4 addresses, payment card numbers (13 to 19 digits with a valid check digit), phone
numbers in international form, secrets (a token, key or password assigned a long value, to its end, dotted parts
too) and names after a gendered title. In a run of digit groups, every span of whole groups that makes a card number
is one; spans that overlap are replaced together, so none is left in clear. Each distinct entity (type and canonical
form: e-mail addresses without case, cards and phones as their digits, shown in the format as written) gets a surrogate drawn from a
keyed hash: letters stay letters of their case, digits digits, card numbers keep a valid check digit, IPv4
octets stay octets, names keep gender and script (Latin, Cyrillic, Greek). The same entity has the same surrogate in
all documents; two entities never share one and no surrogate is an entity of the input: those that would are drawn
anew, and the check is repeated until none is left.

Texts are cut at the entities by one pattern and joined again from parts and surrogates. Only texts with an
entity are exploded, once per distinct text; entities that very many texts hold are joined by a broadcast of bounded
size (`split_join`).

Cases: null text stays null; a text without entities stays as it is; repeated rows get the same text; null doc_id is
kept; other columns, whatever their names, are kept; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, split_join, stored, table, unique_name

#: For real use, give a secret of your own; the same key gives the same surrogates.
KEY = "surrogate-key-1"
MAX_ATTEMPTS = 40
FEMALE, MALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Госпожа|Κυρία", "Mr|Herr|Monsieur|Señor|Sr|Господин|Κύριος"
OCTETS = r"(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])"
VALUE = "[A-Za-z0-9_/+=~-]"
CARD_DIGITS = (13, 19)
#: In order: at a place, the first that fits wins. A card is a whole run of digit groups, up to an IPv4 address.
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9_])(?i:token|secret|password|passwd|api_?key|access_?key)(?-i)[ ]?[=:][ ]?[\"']?" + rf"(?:{VALUE}{{1,64}}\.){{0,4}}{VALUE}{{16,}}+(?:\.{VALUE}++)*+",
    "ip": rf"(?<![0-9.]){OCTETS}",
    "card": rf"(?<![0-9])[0-9](?:(?:[ -](?!{OCTETS}))?[0-9]){{12,}}+",
    "phone": r"(?<![0-9A-Za-z])\+[0-9](?:[ ().-]{0,2}[0-9]){6,13}(?![0-9])",
    "name": rf"(?<![\p{{L}}])(?:{FEMALE}|{MALE})\.? \p{{Lu}}\p{{Ll}}{{1,30}}(?: \p{{Lu}}\p{{Ll}}{{1,30}})?",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
SYLLABLES = {"latin": "ba de fi go lu ma ne ri so ta ve ko".split(), "cyrillic": "ба де фи го лу ма не ри со та ве ко".split(), "greek": "βα δε φι γο λυ μα νε ρι σο τα βε κο".split()}
ENDINGS = {"latin": ("na", "n"), "cyrillic": ("на", "н"), "greek": ("να", "ς")}
#: Country calling codes, by their length; the digits after them from which a surrogate keeps the country (shorter numbers have too few forms).
COUNTRY = "^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
MIN_NATIONAL = 6
TITLE = rf"^(?:{FEMALE}|{MALE})\.? "


def _kind(e: Column) -> Column:
    out = None
    for name, p in PATTERNS.items():
        fits = e.rlike(f"^(?:{p})$")
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out


def _canonical(e: Column, kind: Column) -> Column:
    digits = F.regexp_replace(e, "[^0-9]", "")
    return F.when(kind == "email", F.lower(e)).when(kind.isin("card", "phone"), digits).otherwise(e)


def _bound(value: Column, body) -> Column:
    """body(value), with value computed once however often lambdas in body use it."""
    return F.get(F.transform(F.array(value), body), 0)


def _card_pieces(run: Column) -> Column:
    """A run of digit groups cut into structs (s, card): maximal spans of overlapping card numbers, and what lies between."""
    groups, gaps = F.regexp_extract_all(run, F.lit("[0-9]+"), F.lit(0)), F.regexp_extract_all(run, F.lit("[0-9]([ -]|$)"), F.lit(1))
    return _bound(F.struct(groups.alias("groups"), gaps.alias("gaps")), lambda x: _spans(x["groups"], x["gaps"]))


def _spans(groups: Column, gaps: Column) -> Column:
    low, high = CARD_DIGITS

    def furthest(_: Column, i: Column) -> Column:
        """End of the longest card number from group i on, 0 if there is none; each group has a digit at least."""
        joined = F.transform(F.sequence(F.lit(1), F.lit(high)), lambda k: F.struct((i + k).alias("end"), F.array_join(F.slice(groups, i + 1, k), "").alias("d")))
        valid = F.filter(joined, lambda x: F.length(x["d"]).between(low, high) & F.call_function("luhn_check", x["d"]))
        return F.coalesce(F.array_max(F.transform(valid, lambda x: F.least(x["end"], F.size(groups)))), F.lit(0))

    none = F.array().cast("array<struct<s:string,card:boolean>>")
    start = F.struct(none.alias("out"), F.lit("").alias("s"), F.lit(False).alias("card"), F.lit(0).alias("reach"), F.lit(0).alias("tail"), F.lit(0).alias("i"))

    def step(a: Column, g: Column) -> Column:
        card = F.greatest(a["reach"], g["end"]) > a["i"]
        # a new span begins where no former one reaches, or where the span's first card ends and another begins
        cut = (card != a["card"]) | (card & ((a["reach"] <= a["i"]) | ((a["tail"] == a["i"]) & (g["end"] > a["i"]))))
        text = F.concat(g["d"], g["gap"])
        out = F.when(cut & (a["s"] != ""), F.concat(a["out"], F.array(F.struct(a["s"].alias("s"), a["card"].alias("card"))))).otherwise(a["out"])
        return F.struct(out.alias("out"), F.when(cut, text).otherwise(F.concat(a["s"], text)).alias("s"), card.alias("card"), F.greatest(a["reach"], g["end"]).alias("reach"), F.when(cut, g["end"]).otherwise(a["tail"]).alias("tail"), (a["i"] + 1).alias("i"))

    zipped = F.transform(groups, lambda d, i: F.struct(d.alias("d"), F.coalesce(F.get(gaps, i), F.lit("")).alias("gap"), furthest(d, i).alias("end")))
    return F.aggregate(zipped, start, step, lambda a: F.concat(a["out"], F.array(F.struct(a["s"].alias("s"), a["card"].alias("card")))))


def _formatted(e: Column, digits: Column) -> Column:
    """e with its digits replaced by `digits` in order."""
    place = lambda i: F.length(F.regexp_replace(F.substring(e, F.lit(1), i + 1), "[^0-9]", ""))
    return _bound(digits, lambda d: F.array_join(F.transform(F.split(e, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substring(d, place(i), F.lit(1))).otherwise(c)), ""))


def _number(seed: Column, i: Column | int, n: int) -> Column:
    """A number under n at place i of the keyed stream of seed."""
    return F.pmod(F.xxhash64(seed, F.lit(i) if isinstance(i, int) else i), F.lit(n)).cast("int")


def _pick(values: str, at: Column) -> Column:
    return F.substring(F.lit(values), at + 1, F.lit(1))


def _scrambled(text: Column, seed: Column) -> Column:
    """text with each ASCII letter and digit replaced by another of its kind."""

    def one(c: Column, i: Column) -> Column:
        small_letter = _pick("abcdefghijklmnopqrstuvwxyz", _number(seed, i, 26))
        return F.when(c.rlike("[0-9]"), _pick("0123456789", _number(seed, i, 10))).when(c.rlike("[a-z]"), small_letter).when(c.rlike("[A-Z]"), F.upper(small_letter)).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def surrogate(e: Column, kind: Column, seed: Column) -> Column:
    """What stands for entity e (as written), by a seed that belongs to its canonical form."""
    host = F.regexp_extract(e, r"(\.[A-Za-z]+)$", 1)
    longer = F.floor(F.substring_index(seed, ":", -1).cast("int") / 3).cast("int")  # after each third attempt
    more = F.array_join(F.transform(F.sequence(F.lit(1), longer + 1), lambda i: F.when(i > longer, "").otherwise(_pick("abcdefghijklmnopqrstuvwxyz", _number(seed, i + 2000, 26)))), "")
    email = F.concat(more, _scrambled(F.regexp_extract(e, r"^(.*)\.[A-Za-z]+$", 1), seed), host)
    assigned = F.regexp_extract(e, r"^(\w+ ?[=:] ?[\"']?)", 1)
    secret = F.concat(assigned, _scrambled(F.regexp_replace(e, r"^\w+ ?[=:] ?[\"']?", ""), seed))
    ip = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (_number(seed, i, 254) + 1).cast("string")), ".")
    plain = F.regexp_replace(e, "[^0-9]", "")
    head = _scrambled(F.regexp_extract(plain, r"^(.*)[0-9]$", 1), seed)  # the last digit makes the number valid
    digit = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: d.cast("string"))
    card = _formatted(e, _bound(head, lambda h: F.concat(h, F.get(F.filter(digit, lambda d: F.call_function("luhn_check", F.concat(h, d))), 0))))
    country = F.regexp_extract(plain, COUNTRY, 1)
    national = F.substr(plain, F.length(country) + 1)
    phone = _formatted(e, F.when(F.length(national) >= MIN_NATIONAL, F.concat(country, _scrambled(national, seed))).otherwise(_scrambled(plain, seed)))
    female = e.rlike(rf"^(?:{FEMALE})\.? ")
    bare = F.regexp_replace(e, TITLE, "")
    script = F.when(bare.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(bare.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")

    def made(word: Column, i: Column) -> Column:
        out = None
        for s, syllables in SYLLABLES.items():
            choice = F.array(*map(F.lit, syllables))
            parts = F.slice(F.array(*[F.get(choice, _number(seed, i * 16 + k, len(syllables))) for k in range(1, 13)]), F.lit(1), F.least(3 + longer, F.lit(12)))
            ending = F.when(i > 0, "").when(female, ENDINGS[s][0]).otherwise(ENDINGS[s][1])
            x = F.initcap(F.concat(F.array_join(parts, ""), ending))
            out = F.when(script == s, x) if out is None else out.when(script == s, x)
        return out

    name = F.concat(F.regexp_extract(e, f"({TITLE})", 1), F.array_join(F.transform(F.split(bare, " "), made), " "))
    return F.when(kind == "email", email).when(kind == "secret", secret).when(kind == "ip", ip).when(kind == "card", card).when(kind == "name", name).otherwise(phone)


def _seed(key: str, kind: Column, canonical: Column, attempt: Column) -> Column:
    """Hash of hash with the key in both, as a keyed code."""
    inner = F.sha2(F.concat_ws("\x00", F.lit(key), kind, canonical, attempt.cast("string")), 256)
    return F.concat(F.sha2(F.concat(F.lit(key), inner), 256), F.lit(":"), attempt.cast("string"))


def surrogates(entities: DataFrame, key: str = KEY) -> DataFrame:
    """entities (kind, canonical; distinct) with seed and shown, the surrogate of the canonical form; all differ.

    A surrogate may be neither one of the entities nor another's: in each round the entities concerned, but for the
    smallest of those that share one, go on to their next attempt. Names and e-mail addresses grow by a syllable or
    letter with each third attempt, so that their forms don't run out; where other formats do, an error is raised.
    """
    df = entities.withColumn("attempt", F.lit(0))
    for _ in range(MAX_ATTEMPTS):
        seed = _seed(key, F.col("kind"), F.col("canonical"), F.col("attempt"))
        df = df.select("kind", "canonical", "attempt", seed.alias("seed")).withColumn("shown", surrogate(F.col("canonical"), F.col("kind"), F.col("seed")))
        df = stored(df)
        shared = df.groupBy("kind", F.col("shown").alias("x")).agg(F.min("canonical").alias("first"), F.count("*").alias("n")).where("n > 1")
        taken = df.select("kind", F.col("canonical").alias("x"), F.lit("").alias("first"), F.lit(1).cast("long").alias("n"))
        taken = taken.join(df.select("kind", F.col("shown").alias("x")), ["kind", "x"], "left_semi")
        clash = stored(shared.unionByName(taken).groupBy("kind", F.col("x").alias("shown")).agg(F.min("first").alias("first")))
        if clash.isEmpty():
            return df.select("kind", "canonical", "seed", "shown")
        again = F.col("first").isNotNull() & (F.col("canonical") != F.col("first"))
        df = df.join(clash, ["kind", "shown"], "left").select("kind", "canonical", (F.col("attempt") + again.cast("int")).alias("attempt"))
    raise ValueError(f"some entities' formats have too few forms for distinct surrogates ({MAX_ATTEMPTS} rounds)")


def replaced(docs: DataFrame, key: str = KEY) -> DataFrame:
    """docs with columns `pii_text` (the text with surrogates) and `pii_count` (entities replaced, with repeats)."""
    text = F.col("text")
    marked = docs.select("text").where(text.rlike(PATTERN))
    found = stored(marked.select(F.xxhash64("text").alias("tk"), F.sha2("text", 256).alias("tk2"), F.array_distinct(F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))).alias("es")).distinct())
    each = found.select("tk", "tk2", F.explode("es").alias("e")).withColumn("kind", _kind(F.col("e")))
    whole = F.array(F.struct(F.col("e").alias("s"), F.lit(True).alias("card")))
    pieces = stored(each.select("tk", "tk2", "e", "kind", F.posexplode(F.when(F.col("kind") == "card", _card_pieces(F.col("e"))).otherwise(whole)).alias("at", "p")))
    gap = F.when(F.col("kind") == "card", F.regexp_extract("p.s", "([ -]?)$", 1)).otherwise("")  # behind a card's last group
    each = pieces.where("p.card").select("tk", "tk2", "e", "at", "kind", F.expr("p.s").alias("p"), gap.alias("gap"))
    each = each.withColumn("p", F.when(F.col("gap") != "", F.expr("substring(p, 1, length(p) - 1)")).otherwise(F.col("p")))
    each = each.select("tk", "tk2", "e", "at", "p", "gap", "kind", _canonical(F.col("p"), F.col("kind")).alias("canonical"))
    each = stored(each.withColumn("k", F.sha2(F.concat_ws("\x00", "kind", "canonical"), 256)))
    freq = each.groupBy("kind", "canonical", "k").agg(F.count("*").alias("n"))
    named = stored(surrogates(stored(freq.select("kind", "canonical")), key).join(freq, ["kind", "canonical"]).select("k", "seed", "n"))
    total = each.count()
    given = split_join(each, named, "k", "n", total).select("tk", "tk2", "e", "at", F.concat(surrogate(F.col("p"), F.col("kind"), F.col("seed")), "gap").alias("s"), F.lit(1).alias("n"))
    runs = each.where("kind = 'card'").select("tk", "tk2", "e").distinct()
    between = pieces.where("kind = 'card' AND NOT p.card").join(runs, ["tk", "tk2", "e"], "left_semi").select("tk", "tk2", "e", "at", F.expr("p.s").alias("s"), F.lit(0).alias("n"))
    by_run = given.unionByName(between).repartition("tk", "tk2").groupBy("tk", "tk2", "e").agg(F.array_sort(F.collect_list(F.struct("at", "s"))).alias("ps"), F.sum("n").alias("n"))
    by_run = by_run.select("tk", "tk2", "e", F.struct(F.array_join("ps.s", "").alias("s"), "n").alias("v"))
    maps = stored(by_run.groupBy("tk", "tk2").agg(F.map_from_entries(F.collect_list(F.struct("e", "v"))).alias("m")))

    m = unique_name(docs, "pii_map")
    maps = maps.select(F.col("tk").alias("_m_tk"), F.col("tk2").alias("_m_tk2"), F.col("m").alias(m))
    same = (F.xxhash64(docs["text"]) == maps["_m_tk"]) & (F.sha2(docs["text"], 256) == maps["_m_tk2"])
    size = maps.agg(F.sum(F.length(F.to_json(m)))).first()[0] or 0
    shown, counted = output_names(docs)
    out = docs.join(F.broadcast(maps) if size <= 16 << 20 else maps, same, "left")
    parts, es = F.split(text, PATTERN, -1), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    put = lambda e: F.coalesce(F.element_at(F.col(m), e)["s"], e)
    whole = F.array_join(F.zip_with(parts, es, lambda p, e: F.concat(p, F.when(e.isNull(), "").otherwise(put(e)))), "")
    n = F.aggregate(es, F.lit(0).cast("long"), lambda a, e: a + F.coalesce(F.element_at(F.col(m), e)["n"], F.lit(0).cast("long")))
    touched = F.col(m).isNotNull()
    return out.select(*[docs[c] for c in docs.columns], F.when(touched, whole).otherwise(text).alias(shown), F.when(touched, n).otherwise(0).cast("long").alias(counted))


def output_names(docs: DataFrame) -> tuple[str, str]:
    """Names of the columns that `replaced` adds: pii_text and pii_count, with underscores before them where docs has such columns."""
    return unique_name(docs, "pii_text"), unique_name(docs, "pii_count")


def replace_pii(docs: DataFrame, key: str = KEY) -> DataFrame:
    """The documents (same columns) with surrogates in their texts; n_chars, where there is one, is that of the new text."""
    out = replaced(docs.select("*"), key)
    shown, counted = output_names(docs)
    new = {"text": F.col(shown), "n_chars": F.when(F.col(counted) > 0, F.length(shown)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return out.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def op9_pii(spark, sf_dir: str) -> DataFrame:
    out = replaced(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("pii_count").alias("n_replaced"), F.sha2("pii_text", 256).alias("text_sha256"))
