"""Personal data by weak supervision, in SQL expressions alone.

Fixed patterns find the base spans. Wider patterns propose further candidates, on which labelers
vote: the candidate's own form, gazetteers (some gathered from the documents themselves), its
context and its edges. The counts of vote patterns go through expectation-maximisation, which
estimates the labelers' reliabilities without labels, and the posteriors train a linear span
classifier that is applied as a column expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chelate.llm.common import materialise, small_join, table

#: The kinds in their order, and the base patterns in a form that never goes back over a text.
#: Each starts where a run of its characters does, or where the last match ended, and its repeats are possessive.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Wider candidates, by the kind that they would be.
WIDER = {
    "phone": r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: ?[\[(](?:at|AT)[\])] ?| at )[A-Za-z0-9.-]++(?:(?: ?[\[(](?:dot|DOT)[\])] ?| dot )[A-Za-z0-9-]++)++",
    "name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Señor|Señora)\.? [A-Z][a-z]++(?: [A-Z][a-z]++)?",
    "secret": r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z0-9_+/-]*[0-9])(?=[A-Za-z0-9_+/-]*[A-Za-z])[A-Za-z0-9_+/-]{20,}+={0,2}+(?![A-Za-z0-9_+/=-])",
}
#: What must occur in a text for a pattern to be tried; cheap to look for.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
WIDER_NEEDS = {"email": r"[\[( ](?:at|AT)[\]) ] ?[A-Za-z0-9.-]++[\[( ]+(?:dot|DOT)", "secret": r"[A-Za-z0-9_+/-]{20}", "name": r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Señora?)\.? [A-Z]", "iban": r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", "phone": r"[0-9]{3}[ .-][0-9]{4}", "ssn": r"[0-9]-[0-9]{2}-[0-9]"}
GIVEN_NAMES = "james mary john patricia robert jennifer michael linda david elizabeth william barbara richard susan joseph thomas sarah charles karen daniel anna maria peter hans klaus ursula pierre marie jean sophie carlos lucia jose carmen".split()
CONTEXT = r"(?i)(?:phone|tel|call|fax|mobil|mail|contact|contacto|kontakt|ssn|social security|iban|account|konto|compte|cuenta|name|nom|nombre|signed|write to)[^A-Za-z]{0,6}(?:[a-z]{1,8}[^A-Za-z]{1,3})?$"
#: What a secret is given to, and how well-known ones begin.
ASSIGNED = r"(?i)(?:token|secret|passw(?:or)?d|passphrase|api[_ -]?key|access[_ -]?key|private[_ -]?key|client[_ -]?id|bearer|authorization|credentials?)[^A-Za-z0-9]{0,8}$"
PREFIXES = r"^(?:AKIA|ASIA|AIza|gh[pousr]_|glpat-|sk-|sk_live_|xox[abprs]-|eyJ)"
#: Characters of a span's surroundings that labelers see.
BEFORE, AFTER = 40, 2
#: Entries of a gathered gazetteer that are looked up in place, the most frequent, while all others are joined; documents in which each must stand.
GATHERED, STANDS = 1_000, 2
KINDS = [*BASE, *(k for k in WIDER if k not in BASE)]
SPAN = "struct<start:int,end:int,kind:string,m:string,before:string,after:string>"
KEEP = 0.5
LABELERS = ("form", "gazetteer", "context", "edges")


#: Matches whose lengths are added up at once.
CHUNK = 256


def found(text: str, hits: str, pattern: str, kind: str) -> Column:
    """Spans with code point offsets: the parts between matches and the matches tell where each stands.

    Lengths are added up by chunks, so a text of many matches takes time near linear in them.
    """
    gaps = f"split({text}, r'{pattern}', -1)"
    lengths = "transform(p.hits, (h, i) -> length(p.gaps[i]) + length(h))"
    chunks = f"transform(sequence(0, (size(l) - 1) div {CHUNK}), b -> aggregate(slice(l, int(b * {CHUNK} + 1), {CHUNK}), 0, (s, x) -> s + x))"
    before = f"aggregate({chunks}, array(0), (s, x) -> concat(s, array(s[size(s) - 1] + x)))"
    end = f"c[int(i div {CHUNK})] + aggregate(slice(l, int(i div {CHUNK} * {CHUNK} + 1), i % {CHUNK} + 1), 0, (s, x) -> s + x)"
    span = f"named_struct('start', e - length(h), 'end', e, 'kind', '{kind}', 'm', h, 'before', right(p.gaps[i], {BEFORE}), 'after', left(p.gaps[i + 1], {AFTER}))"
    # each value used more than once is bound once, as the one element of an array
    bound = f"transform(array({lengths}), l -> transform(array({before}), c -> transform(p.hits, (h, i) -> transform(array({end}), e -> {span})[0]))[0])[0]"
    return F.expr(f"CASE WHEN size({hits}) > 0 THEN transform(array(named_struct('gaps', {gaps}, 'hits', {hits})), p -> {bound})[0] ELSE cast(array() as array<{SPAN}>) END")


def valid(kind: str, m: str) -> str:
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    luhn = f"aggregate(transform(sequence(1, length({digits})), i -> int(substring({digits}, length({digits}) - i + 1, 1)) * IF(i % 2 = 0, 2, 1)), 0, (a, x) -> a + IF(x > 9, x - 9, x)) % 10 = 0"
    part = "regexp_replace(p, '^0+', '')"
    return {
        "email": "true",
        "ip": f"forall(split({m}, '[.]'), p -> length({part}) <= 3 AND coalesce(try_cast({part} AS int), 0) <= 255)",
        "card": luhn,
        "phone": f"length({digits}) BETWEEN 10 AND 15",
    }[kind]


def iban_rest(m: str) -> str:
    """Of an account number, its rest modulo 97: country and check digits go last, letters count from 10."""
    moved = f"concat(substring({m}, 5), left({m}, 4))"
    value = "IF(c BETWEEN '0' AND '9', ascii(c) - 48, ascii(c) - 55)"
    return f"aggregate(split({moved}, ''), 0, (a, c) -> IF(c = '', a, (a * IF(c BETWEEN '0' AND '9', 10, 100) + {value}) % 97))"


def candidates(docs: DataFrame) -> DataFrame:
    """id, base and wider: each row's valid base spans, and candidates that overlap none of these."""
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    seek = lambda p, need: F.when(need, F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(F.array().cast("array<string>"))
    digits = F.col("text").rlike("[0-9]")
    first = {f"h_{k}": seek(p, F.instr("text", NEEDS[k]) > 0 if k in NEEDS else digits) for k, p in BASE.items()}
    first |= {f"w_{k}": seek(p, F.col("text").rlike(WIDER_NEEDS[k])) for k, p in WIDER.items()}
    rows = rows.withColumns(first)
    spans = {f"b_{k}": found("text", f"h_{k}", p, k) for k, p in BASE.items()}
    spans |= {f"c_{k}": found("text", f"w_{k}", p, k) for k, p in WIDER.items()}
    rows = rows.withColumns(spans)
    base = ", ".join(f"filter(b_{k}, s -> {valid(k, 's.m')})" for k in BASE)
    rows = rows.select("id", F.expr(f"concat({base})").alias("base"), F.concat(*[F.col(f"c_{k}") for k in WIDER]).alias("wider"))
    free = "filter(wider, s -> NOT exists(base, b -> b.start < s.end AND s.start < b.end))"
    return rows.withColumn("wider", F.expr(free))


#: A spelled address as it is written plainly, and its domain.
PLAIN = r"regexp_replace(regexp_replace({}, ' ?[\\[( ](?i:at)[\\]) ] ?', '@'), ' ?[\\[( ](?i:dot)[\\]) ] ?', '.')"
DOMAIN = "regexp_extract(lower({}), '([a-z0-9-]+[.][a-z0-9-]+)$', 1)"
FIRST = "regexp_extract(lower({}), '^[^ ]+ ([^ ]+)', 1)"


#: The words of a wider span that its kind's gathered gazetteer is asked for.
ASKED = {"email": f"array({DOMAIN.format(PLAIN.format('{0}.m'))})", "name": "split(lower({0}.m), '[ .]+')"}


def gathered(rows: DataFrame) -> tuple[dict[str, list[str]], DataFrame]:
    """Domains of base addresses, and first names that follow titles, in STANDS documents or more.

    GATHERED of each kind, the most frequent, as lists; all others as rows of kind and word.
    """
    first, rest = {}, []
    for spans, kind, word in (("base", "email", DOMAIN.format("x.m")), ("wider", "name", FIRST.format("x.m"))):
        words = rows.select(F.explode(F.expr(f"array_distinct(transform(filter({spans}, x -> x.kind = '{kind}'), x -> {word}))")).alias("word"))
        counts = materialise(words.where("word <> ''").groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= STANDS))
        first[kind] = [r.word for r in counts.orderBy(F.desc("n"), "word").limit(GATHERED).collect()]
        rest.append(counts.where(~F.col("word").isin(first[kind])).select(F.lit(kind).alias("kind"), "word"))
    return first, rest[0].unionByName(rest[1])


def with_listed(rows: DataFrame, rest: DataFrame) -> DataFrame:
    """rows with ``listed``: of the words that a row's wider spans ask for, those (as kind:word) that are among ``rest``.

    rows have to be written, so that a row has the same number in both branches. A word that many
    documents ask for but few give is joined like any other: the join's skew handling splits it.
    """
    if rest.isEmpty():
        return rows.withColumn("listed", F.expr("cast(array() AS array<string>)"))
    asked = ", ".join(f"flatten(transform(filter(wider, x -> x.kind = '{k}'), x -> transform({w.format('x')}, y -> concat('{k}:', y))))" for k, w in ASKED.items())
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    words = rows.select("row", F.explode(F.expr(f"array_distinct(concat({asked}))")).alias("word"))
    found = small_join(words, rest.select(F.concat_ws(":", "kind", "word").alias("word")), "word", "inner")
    found = found.groupBy("row").agg(F.collect_list("word").alias("listed"))
    return rows.join(found, "row", "left").drop("row").withColumn("listed", F.expr("coalesce(listed, cast(array() AS array<string>))"))


def votes(s: str, domains: list[str], names: list[str]) -> str:
    """Each labeler's vote on span s: 1 personal data, -1 not, 0 none, in the order of LABELERS. Reads the column ``listed``."""
    digits = f"regexp_replace({s}.m, '[^0-9]', '')"
    listed = lambda words: "array(" + ", ".join("'" + w.replace("\\", "").replace("'", "") + "'" for w in words) + ")" if words else "cast(array() AS array<string>)"
    # the gazetteers' other entries, as far as the row asks for them
    others = lambda kind: f"(size(listed) > 0 AND exists({ASKED[kind].format(s)}, w -> array_contains(listed, concat('{kind}:', w))))"
    form = f"""CASE {s}.kind
        WHEN 'phone' THEN IF({digits} RLIKE '^[2-9][0-9]{{2}}[2-9]', 1, -1)
        WHEN 'ssn' THEN IF({digits} RLIKE '^(?!000|666|9)[0-9]{{3}}(?!00)[0-9]{{2}}(?!0000)', 1, -1)
        WHEN 'iban' THEN IF(length(replace({s}.m, ' ', '')) BETWEEN 15 AND 34 AND {iban_rest(f"replace({s}.m, ' ', '')")} = 1, 1, -1)
        WHEN 'email' THEN IF({s}.m LIKE '% at %' AND NOT {PLAIN.format(s + '.m')} RLIKE '[.][A-Za-z]{{2,}}$', -1, 1)
        WHEN 'secret' THEN IF({s}.m RLIKE '^(?:[0-9a-f]{{32,}}|[0-9A-F]{{32,}})$' OR ({s}.m RLIKE '[a-z]' AND {s}.m RLIKE '[A-Z]' AND NOT {s}.m RLIKE '[a-z]{{6}}'), 1, -1)
        ELSE 0 END"""
    gazetteer = f"""CASE {s}.kind WHEN 'name' THEN IF(exists(split(lower({s}.m), '[ .]+'), w -> array_contains({listed([*GIVEN_NAMES, *names])}, w)) OR {others('name')}, 1, 0)
        WHEN 'email' THEN IF(array_contains({listed(domains)}, {DOMAIN.format(PLAIN.format(s + '.m'))}) OR {others('email')} OR {PLAIN.format(s + '.m')} RLIKE '(?i)[.](com|org|net|edu|gov|de|fr|es|io)$', 1, -1)
        WHEN 'secret' THEN IF({s}.m RLIKE '{PREFIXES}', 1, 0) ELSE 0 END"""
    context = f"IF({s}.before RLIKE IF({s}.kind = 'secret', r'{ASSIGNED}', r'{CONTEXT}'), 1, 0)"
    # whole edges say nothing, broken ones that the candidate is part of something else
    edges = f"IF({s}.before RLIKE '[0-9A-Za-z#$/_]$' OR {s}.after RLIKE '^[0-9A-Za-z/_]', -1, 0)"
    return f"array({form}, {gazetteer}, {context}, {edges})"


def reliabilities(patterns: dict[tuple[int, ...], int], rounds: int = 50) -> dict[tuple[int, ...], float]:
    """P(personal data) of each vote pattern by expectation-maximisation, from the balance of its votes.

    A labeler's silence says nothing; its votes on either class start out right four times of five.
    """
    p = {k: 1 / (1 + math.exp(-1.5 * sum(k))) for k in patterns}
    for _ in range(rounds):
        mass = sum(n * p[k] for k, n in patterns.items())
        whole = sum(patterns.values())
        odds = dict.fromkeys(patterns, math.log((mass + 1) / (whole - mass + 1)))
        for j in range(len(LABELERS)):
            for_, against = {1: 4.0, -1: 1.0}, {1: 1.0, -1: 4.0}
            for k, n in patterns.items():
                if k[j]:
                    for_[k[j]] += n * p[k]
                    against[k[j]] += n * (1 - p[k])
            for k in patterns:
                if k[j]:
                    odds[k] += math.log(for_[k[j]] / sum(for_.values())) - math.log(against[k[j]] / sum(against.values()))
        p = {k: 1 / (1 + math.exp(-max(-30.0, min(30.0, o)))) for k, o in odds.items()}
    return p


def classifier(patterns: dict[tuple[int, ...], int], p: dict[tuple[int, ...], float], rounds: int = 400, rate: float = 1.0) -> list[float]:
    """Weights of the labelers' votes and a bias, by logistic gradients towards the posteriors; starts at 1 for each vote."""
    w = [1.0] * len(LABELERS) + [-1.0]
    whole = sum(patterns.values()) or 1
    for _ in range(rounds):
        grad = [0.01 * x for x in w]
        for k, n in patterns.items():
            x = (*k, 1)
            z = max(-30.0, min(30.0, sum(a * b for a, b in zip(w, x, strict=True))))
            e = n / whole * (1 / (1 + math.exp(-z)) - p[k])
            grad = [g + e * v for g, v in zip(grad, x, strict=True)]
        w = [a - rate * g for a, g in zip(w, grad, strict=True)]
    return w


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, base and added, arrays of (start, end, kind, score).

    Offsets count code points, ends are exclusive. base: the fixed patterns' valid matches (score
    1), which always stay; added: candidates that the trained classifier accepts. A null text is
    empty and has none. Repeated rows are found alike; an empty table gives an empty result; other
    columns aren't read. Vote patterns, at most 3 to the power of the labelers, and GATHERED
    entries of each gazetteer are all that reaches the driver. Spans alone are written between the passes, not texts.
    """
    rows = materialise(candidates(docs))
    first, rest = gathered(rows)
    voted, rows = votes("s", first["email"], first["name"]), with_listed(rows, rest)
    slim = "transform({0}, s -> named_struct('start', s.start, 'end', s.end, 'kind', s.kind, 'votes', {1}))"
    rows = materialise(rows.select("id", F.expr(slim.format("base", "cast(array() as array<int>)")).alias("base"), F.expr(slim.format("wider", voted)).alias("wider")))
    counted = rows.select(F.explode("wider.votes").alias("votes")).groupBy("votes").count().collect()
    patterns = {tuple(r.votes): r["count"] for r in counted}
    w = classifier(patterns, reliabilities(patterns))
    z = " + ".join(f"{x:.6f}D * s.votes[{j}]" for j, x in enumerate(w[:-1])) + f" + {w[-1]:.6f}D"
    scored = f"filter(transform(wider, s -> named_struct('start', s.start, 'end', s.end, 'kind', s.kind, 'score', 1 / (1 + exp(-({z}))))), s -> s.score >= {KEEP})"
    sure = "transform(base, s -> named_struct('start', s.start, 'end', s.end, 'kind', s.kind, 'score', 1D))"
    return rows.select(F.col("id").alias("doc_id"), F.expr(sure).alias("base"), F.expr(scored).alias("added"))


def text_of(spans: str) -> str:
    """kind:start:end by start, then kind as listed, comma-joined."""
    order = f"array_position(array({', '.join(repr(k) for k in KINDS)}), s.kind)"
    keyed = f"array_sort(transform({spans}, s -> named_struct('a', s.start, 'k', {order}, 'e', s.end, 'kind', s.kind)))"
    return f"array_join(transform({keyed}, s -> concat(s.kind, ':', s.a, ':', s.e)), ',')"


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = personal_data(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in BASE],
        F.expr(f"sha2({text_of('base')}, 256)").alias("base_sha256"),
        F.expr(text_of("concat(base, added)")).alias("spans"),
        F.expr("cast(size(base) + size(added) AS bigint)").alias("n_spans"),
    )


QUERIES = {"op6_pii": op6_pii}
ORACLES: dict[str, str] = {}  # SQL has no offsets of matches: the tests compare with a plain scan
