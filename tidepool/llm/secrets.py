"""Secret scans: fixed patterns, and character Markov models that tell random strings from identifiers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.store import bind, with_text

#: The base patterns, in the order of their kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (("assign", ASSIGN), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+"))
LEAST = {"assign": 6, "access": 20, "hex": 24}

#: The kind that the models add: runs of these characters, judged whole.
CANDIDATE = "[A-Za-z0-9+/_=-]{16,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"

#: Rows of each label that the models are trained on, and the log-likelihood ratio (bits) from which a
#: candidate is a secret: for the whole string, and for each of its steps.
SAMPLES = 4000
MIN_BITS = 16.0
MIN_BITS_A_STEP = 0.75

#: Characters of a candidate's part that is judged alone.
LEAST_PART = 12

#: Matches or spans that are worked on together, so that a text with many takes little more than linear time.
BLOCK = 256

#: Marks around matches; in a text, they are replaced before, by another character that no pattern takes.
OPEN, CLOSE, INSTEAD = "\ue000", "\ue001", "\ue002"

#: Ordinary words that the identifiers of the labelled sample are made of.
WORDS = """
account action address after amount and archive array auch average backup batch because before block branch buffer
builder cache calendar callback category channel character checkpoint client cluster collection column command
commit compute condition config connection container content context controller counter country create current
customer dans database date default delete delivery department description development device dictionary
dimension directory distance document domain download driver einer element email enable encoder engine entity error
event example exception execute expression factory failure feature field filter finder folder format fragment
function future gateway generate global graphics group handler header height helper history identifier image
import index initial input insert instance integer interface internal invoice isolation item iterator joined
journal kernel keyboard language latest layout length level library limit listener location logger machine
manager mapping matrix maximum measure memory message metadata method minimum mobile module monitor network nicht
normal notification number object offset operation option order organisation output package parameter parent
parser partition password pattern payment performance permission picture platform plugin pointer policy position
previous print priority process producer product profile project property protocol provider public query
queue random reader record reference region register release remote render repository request resource
response result return review router runtime sample schedule schema scope screen search section security segment
selector sequence server service session setting signal simple source special standard state station status
storage stream string structure style subject summary support switch symbol system table target template
temporary terminal text thread threshold timeout title token toolbar tracker transaction transfer transform tree
trigger type unique update upload user utility valid value vector verify version video view virtual visible
volume warning weight widget window worker wrapper writer año calidad como desde después entre gestion hasta
informacion mientras nueva para pero porque servicio sobre todos usuario avec cette comme depuis elle entreprise
gestionnaire jusque leur mais nouvelle pendant pour quelque sans societe toujours vers abteilung ausgabe benutzer
bestellung datei einstellung fehler freigabe geschichte gesellschaft kunde leistung nachricht rechnung schule
sicherheit sprache straße unterstützung verbindung verwaltung verzeichnis vorgang werkzeug wirtschaft zeichen
zugriff
"""


def labelled_samples(spark: SparkSession, rows: int = SAMPLES, seed: int = 0) -> DataFrame:
    """``text, is_random``: ``rows`` strings of either label; another ``seed`` gives others, to test on.

    Random ones are base64, base64 in URLs, letters with digits, and upper-case letters with digits, cut from SHA-512
    digests. Ordinary ones are identifiers, paths and dates of one to five of ``WORDS`` in the usual spellings.
    """
    n = spark.range(rows).withColumn("h", F.sha2(F.concat_ws(":", F.lit(seed), "id").cast("binary"), 512))
    digest = F.base64(F.unhex("h"))
    size = 16 + F.pmod(F.xxhash64("h"), F.lit(49))
    random = F.element_at(
        F.array(
            digest,
            F.translate(digest, "+/", "-_"),
            F.regexp_replace(digest, "[+/=]", ""),
            F.upper(F.regexp_replace(digest, "[^A-Z0-9]", "")),
        ),
        (F.pmod("id", F.lit(4)) + 1).cast("int"),
    )
    words = F.array(*[F.lit(w) for w in WORDS.translate(str.maketrans("ñéüß", "neus")).split()])

    def pick(i: int) -> Column:
        return F.get(words, F.pmod(F.xxhash64("h", F.lit(i)), F.size(words)).cast("int"))

    chosen = F.array(*[pick(i) for i in range(5)])
    some = F.slice(chosen, 1, (1 + F.pmod(F.xxhash64(F.lit("n"), "h"), F.lit(5))).cast("int"))
    number = F.when(F.pmod(F.xxhash64(F.lit("d"), "h"), F.lit(4)) == 0, F.pmod(F.xxhash64("h"), F.lit(2100)).cast("string")).otherwise("")
    camel = F.regexp_replace(F.initcap(F.array_join(some, " ")), " ", "")
    ordinary = F.element_at(
        F.array(
            F.array_join(some, "_"),
            F.array_join(some, "-"),
            camel,
            F.concat(F.lower(F.substring(camel, 1, 1)), F.substring(camel, 2, 200)),
            F.array_join(some, ""),
            F.upper(F.array_join(some, "_")),
            F.concat(F.lit("/"), F.array_join(some, "/")),
            F.concat(F.array_join(some, "-"), F.lit("-2024-05-17")),
        ),
        (F.pmod("id", F.lit(8)) + 1).cast("int"),
    )
    rows_random = n.select(F.substr(random, F.lit(1), size.cast("int")).alias("text"), F.lit(True).alias("is_random"))
    return rows_random.unionByName(n.select(F.concat(ordinary, number).alias("text"), F.lit(False).alias("is_random")))


def train(samples: DataFrame) -> list[float]:
    """Log ratios (bits) of the step from each character to the next, random over ordinary, by one-added counts.

    The result has a number for each pair of ``ALPHABET`` characters, whatever the number of samples. Null texts, and steps over
    other characters, are skipped.
    """
    chars = F.filter(F.split("text", ""), lambda c: F.length(c) == 1)
    steps = samples.select("is_random", F.explode(F.zip_with(chars, F.slice(chars, 2, F.greatest(F.size(chars) - 1, F.lit(0))), lambda a, b: F.concat(a, b))).alias("step"))
    counted = steps.where("step is not null").groupBy("is_random", "step").agg(F.count(F.lit(1)).alias("n")).collect()
    n = {(r.is_random, r.step): r.n for r in counted}
    size, ratios = len(ALPHABET), []
    for a in ALPHABET:
        total = {label: size + sum(n.get((label, a + b), 0) for b in ALPHABET) for label in (True, False)}
        ratios += [math.log2((n.get((True, a + b), 0) + 1) / total[True] * total[False] / (n.get((False, a + b), 0) + 1)) for b in ALPHABET]
    return ratios


def _steps(token: Column, ratios: list[float], use) -> Column:
    """``use`` of the log ratios of a string's steps."""
    table = F.split(F.lit(",".join(f"{x:.4f}" for x in ratios)), ",").cast("array<double>")
    place = F.split(F.lit(",".join(str(ALPHABET.find(chr(i))) for i in range(128))), ",").cast("array<int>")
    codes = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.get(place, F.ascii(c)))
    return bind(
        codes,
        lambda c: use(F.zip_with(c, F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), lambda a, b: F.coalesce(F.get(table, a * len(ALPHABET) + b), F.lit(0.0)))),
    )


def score(token: Column, ratios: list[float]) -> Column:
    """A string's log-likelihood ratio in bits; its characters must be of ``ALPHABET``."""
    return _steps(token, ratios, lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v))


def random_parts(token: Column, ratios: list[float], min_bits: float = MIN_BITS, min_bits_a_step: float = MIN_BITS_A_STEP) -> Column:
    """``struct(start, end)`` of a candidate's random parts: all of it, or its runs of steps that have so many bits more than ``min_bits_a_step`` for each.

    A run ends at its maximum, once the sum falls to 0 or by ``min_bits`` under it. It needs ``LEAST_PART`` characters, and is
    widened to the next "=" or "/" on either side.
    """
    kind = "array<struct<start:int,end:int>>"
    none = {"sum": F.lit(0.0), "start": F.lit(0), "best": F.lit(0.0), "end": F.lit(0)}

    def state(i: Column, out: Column, **x: Column) -> Column:
        return F.struct(i.alias("i"), *[x[k].alias(k) for k in none], out.alias("out"))

    def ended(s: Column) -> Column:
        ok = (s["best"] >= min_bits) & (s["end"] - s["start"] >= LEAST_PART)
        return F.when(ok, F.concat(s["out"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))).otherwise(s["out"])

    def step(s: Column, x: Column) -> Column:
        total = s["sum"] + x - min_bits_a_step
        i = s["i"] + 1
        over = (total <= 0) | (total <= s["best"] - min_bits)
        more = total > s["best"]
        on = state(i, s["out"], sum=total, start=s["start"], best=F.greatest(s["best"], total), end=F.when(more, i + 1).otherwise(s["end"]))
        return F.when(over, state(i, ended(s), **(none | {"start": i}))).otherwise(on)

    def widened(p: Column) -> Column:
        left = F.substr(token, F.lit(1), p["start"])
        right = F.substr(token, p["end"] + 1)
        start = p["start"] - F.length(F.regexp_extract(left, "[^=/]*$", 0))
        return F.struct(start.cast("int").alias("start"), (p["end"] + F.length(F.regexp_extract(right, "^[^=/]*", 0))).cast("int").alias("end"))

    def judged(x: Column) -> Column:
        total, n = F.aggregate(x, F.lit(0.0), lambda s, v: s + v), F.length(token)
        whole = (total >= min_bits) & (total >= min_bits_a_step * (n - 1))
        runs = F.aggregate(x, state(F.lit(0), F.array().cast(kind), **none), step, ended)
        return F.when(whole, F.array(F.struct(F.lit(0).alias("start"), n.cast("int").alias("end")))).otherwise(F.array_distinct(F.transform(runs, widened)))

    return _steps(token, ratios, lambda x: bind(x, judged))


def _blocks(items: Column) -> Column:
    """An array in slices of ``BLOCK``; an empty one in an empty slice."""
    last = ((F.size(items) - 1) / BLOCK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(items, b * BLOCK + 1, BLOCK))


def _found(text: Column, kind: str, rank: int, pattern: str, parts_of) -> Column:
    """Spans of what ``parts_of`` gives (``struct(start, end)``) of a pattern's leftmost non-overlapping matches, in code points.

    Matches are put between two marks that no pattern matches (in the text, they were replaced before); the parts
    between marks then give the places: first from the start of their block of parts, then from the text's.
    """
    marked = F.regexp_replace(text, f"({pattern})", f"{OPEN}$0{CLOSE}")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, part: Column) -> Column:
        own = F.transform(
            bind(F.substring_index(part, CLOSE, 1), parts_of),
            lambda p: F.struct((acc["at"] + p["start"]).alias("start"), (acc["at"] + p["end"]).alias("end")),
        )
        spans = F.when(F.contains(part, F.lit(CLOSE)), F.concat(acc["spans"], own)).otherwise(acc["spans"])
        return F.struct((acc["at"] + F.length(part) - F.when(F.contains(part, F.lit(CLOSE)), 1).otherwise(0)).alias("at"), spans.alias("spans"))

    def shifted(acc: Column, block: Column) -> Column:
        spans = F.transform(
            block["spans"],
            lambda s: F.struct((acc["at"] + s["start"]).alias("start"), F.lit(rank).alias("rank"), (acc["at"] + s["end"]).alias("end"), F.lit(kind).alias("kind")),
        )
        return F.struct((acc["at"] + block["at"]).alias("at"), F.concat(acc["spans"], F.array(spans)).alias("spans"))

    parts = bind(marked, lambda m: F.when(F.contains(m, F.lit(OPEN)), F.split(m, OPEN)).otherwise(F.array(F.lit(""))))
    blocks = F.transform(bind(parts, _blocks), lambda x: F.aggregate(x, start, step))
    whole = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,rank:int,end:int,kind:string>>>").alias("spans"))
    return F.aggregate(blocks, whole, shifted, lambda a: F.flatten(a["spans"]))


def _gaps(text: Column, spans: Column) -> Column:
    """``struct(from, to, gap)``: what is before each run of overlapping spans and not in one; ``spans`` are in order of start.

    A block of spans cuts its own part of the text out first.
    """

    def of_block(x: Column, before: Column) -> Column:
        start = F.struct(before.alias("end"), F.array().cast("array<struct<from:int,to:int,gap:string>>").alias("out"))

        def step(region: Column):
            def one(acc: Column, s: Column) -> Column:
                gap = F.substr(region, acc["end"] - before + 1, F.greatest(s["start"] - acc["end"], F.lit(0)))
                more = F.concat(acc["out"], F.array(F.struct(acc["end"].alias("from"), s["start"].alias("to"), gap.alias("gap"))))
                return F.struct(F.greatest(acc["end"], s["end"]).alias("end"), F.when(s["start"] < acc["end"], acc["out"]).otherwise(more).alias("out"))

            return one

        length = F.coalesce(F.greatest(F.get(x, F.size(x) - 1)["start"] - before, F.lit(0)), F.lit(0))
        return bind(F.substr(text, before + 1, length), lambda region: F.aggregate(x, start, step(region), lambda acc: acc["out"]))

    def of_all(blocks: Column) -> Column:
        ends = F.transform(blocks, lambda x: F.array_max(F.transform(x, lambda s: s["end"])))
        return bind(ends, lambda e: F.flatten(F.transform(blocks, lambda x, b: bind(F.coalesce(F.array_max(F.slice(e, F.lit(1), b)), F.lit(0)), lambda before: of_block(x, before)))))

    return bind(bind(spans, _blocks), of_all)


def _rest(text: Column, spans: Column) -> Column:
    """What is behind all spans."""
    return F.substr(text, F.array_max(F.transform(spans, lambda s: s["end"])) + 1)


def _without(text: Column, spans: Column) -> Column:
    """The text with the characters of spans replaced by ones that no candidate has."""

    def joined(gaps: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            return F.concat(F.repeat(F.lit(INSTEAD), x["from"] - F.coalesce(F.get(gaps, i - 1)["to"], x["from"])), x["gap"])

        end = F.array_max(F.transform(spans, lambda s: s["end"]))
        last = F.repeat(F.lit(INSTEAD), end - F.get(gaps, F.size(gaps) - 1)["to"])
        return F.concat(F.array_join(F.transform(gaps, one), ""), last, _rest(text, spans))

    return F.when(F.size(spans) > 0, bind(_gaps(text, spans), joined)).otherwise(text)


def find_secrets(docs: DataFrame, ratios: list[float], min_bits: float = MIN_BITS, min_bits_a_step: float = MIN_BITS_A_STEP) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of ``struct(start, rank, end, kind)`` in order of start, then kind.

    ``base`` holds the fixed patterns' spans; ``spans`` adds, as kind ``random``, the parts of candidates, outside base spans, whose
    ratio is high enough (see ``random_parts``). Offsets are code points, ends exclusive. A null text has none. All rows and columns
    stay; columns of these two names are replaced.
    """
    names = [c for c in docs.columns if c not in ("base", "spans")]
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), OPEN + CLOSE, INSTEAD * 2)

    def long_enough(kind: str, pattern: str):
        def parts(m: Column) -> Column:
            n = F.length(F.regexp_extract(m, pattern, 2)) if kind == "assign" else F.length(m)
            whole = F.struct(F.lit(0).alias("start"), F.length(m).alias("end"))
            return F.when(n >= LEAST[kind], F.array(whole)).otherwise(F.array().cast("array<struct<start:int,end:int>>"))

        return parts

    base = F.concat(*[_found(text, k, i, p, long_enough(k, p)) for i, (k, p) in enumerate(BASE)])

    rows = docs.select(F.struct("*").alias("_doc"), text.alias("_rest"), F.array_sort(base).alias("base"))
    rest = _without(F.col("_rest"), F.col("base"))
    rows = rows.select("_doc", "base", _found(rest, "random", len(BASE), CANDIDATE, lambda m: random_parts(m, ratios, min_bits, min_bits_a_step)).alias("new"))
    return rows.select(*[F.col("_doc")[c].alias(c) for c in names], "base", F.array_sort(F.concat("base", "new")).alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, ratios: list[float], mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``; spans that overlap share one. All rows and columns stay; ``n_chars`` follows."""
    rows = find_secrets(docs.select(F.struct("*").alias("_doc"), "text"), ratios)
    kept = F.transform(_gaps(F.col("text"), F.col("spans")), lambda x: x["gap"])
    whole = F.array_join(F.concat(kept, F.array(_rest(F.col("text"), F.col("spans")))), mark)
    new = F.when(F.size("spans") > 0, whole).otherwise(F.col("text"))
    return with_text(rows.select("_doc", new.alias("_text")), docs.columns)
