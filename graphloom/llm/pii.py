"""Personal data by candidate generation and gradient-boosted trees, in SQL expressions only.

Four exact patterns with their checks (octets, Luhn, digit counts) give the base
spans, which always stay. High-recall generators propose further, overlapping
spans: written-out and defanged forms, numbers that fail their check by a digit,
national telephone numbers, and secrets, a fifth kind. Boosted trees score the
proposals by format and context; a threshold for each kind, calibrated on
examples that the trees have not seen, selects those that are redacted as well.

No labelled personal data exist here, so the labelled rows are made: ``EXAMPLES``
short texts from ``TEMPLATES``, with random letters and digits, for each kind of
proposal ones that are personal data and ones that only look so (versions, order
numbers, identifiers, checksums, place-holders). They pass through the same
generators and features as documents. They depend on nothing else, so a document
is treated alike in any table.

The patterns are those of the kinds, written so that Java's matcher neither
backtracks nor recurses: possessive, and starting only where a match can start.
"""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh

#: The first four have a base pattern.
KINDS = ("email", "ip", "card", "phone", "secret")
#: Kind, cheap test, pattern, check on the match ``m`` (null: none).
LUHN = """
aggregate(
  transform(split(reverse(regexp_replace(x.m, '[^0-9]', '')), ''), (d, i) -> cast(d as int) * (1 + i % 2)),
  0, (n, d) -> n + d - if(d > 9, 9, 0)) % 10 = 0
"""
OCTETS = "forall(split(x.m, '[.]'), p -> length(ltrim('0', p)) <= 3 and cast(concat('0', left(ltrim('0', p), 3)) as int) <= 255)"
DIGITS = "length(regexp_replace(x.m, '[^0-9]', '')) between 10 and 15"
BASE = (
    ("email", "text like '%@%'", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "true"),
    ("ip", r"text rlike r'[0-9]\.[0-9]'", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", OCTETS),
    ("card", r"text rlike r'[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]'", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])", LUHN),
    ("phone", r"text rlike r'\+[0-9]'", r"\+[0-9][ ().0-9-]+[0-9]", DIGITS),
)
#: Kind, cheap test, pattern of proposals beyond the base.
PROPOSED = (
    ("email", "text like '%@%'", r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?![.@A-Za-z0-9-])"),
    ("email", r"text rlike r'(?i)[\[(]at[\])]'", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++ ?[\[(]at[\])] ?[a-z0-9-]++(?: ?(?:\.|[\[(]dot[\])]) ?[a-z0-9-]++){1,6}+"),
    ("email", "text like '% at % dot %'", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ at [A-Za-z0-9-]++(?: dot [A-Za-z0-9-]++){1,6}+"),
    ("ip", "text like '%[.]%'", r"(?<![0-9])[0-9]{1,3}+(?:\[\.\][0-9]{1,3}+){3}(?![0-9])"),
    ("ip", r"text rlike r'[0-9]\.[0-9]'", r"(?<![0-9.])[0-9]{1,9}+(?:\.[0-9]{1,9}+){3}(?![0-9.])"),
    ("ip", r"text rlike r'[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:'", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}+:){5,7}+[0-9A-Fa-f]{1,4}+(?![0-9A-Za-z:])"),
    ("card", r"text rlike r'[0-9]{4}[ -][0-9]{4}'", r"(?<![0-9])[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])"),
    ("card", "text rlike '[0-9]{14}'", r"(?<![0-9A-Za-z])[0-9]{14,19}+(?![0-9A-Za-z])"),
    ("phone", r"text rlike r'[0-9]{3}[)]?[ .-]?[0-9]{3}[ .-][0-9]{4}'", r"(?<![0-9A-Za-z+.(-])[(]?[0-9]{3}[)]?[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    ("phone", r"text rlike r'\+[0-9]'", r"(?<![0-9A-Za-z+])\+[0-9](?:[ .-]?[0-9]){5,20}+(?![0-9])"),
    ("secret", "text rlike '(?i)(?:password|passwd|pwd|secret|token|api[_-]?key) ?[=:]'", r"(?i)(?<![a-z0-9])(?:password|passwd|pwd|secret|token|api[_-]?key) ?[=:] ?[^\s,;]{4,}+"),
    ("secret", "text rlike 'AKIA|ghp_|sk-'", r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}+)(?![A-Za-z0-9])"),
    ("secret", "text rlike '[0-9a-f]{32}'", r"(?<![0-9A-Za-z])[0-9a-f]{32,}+(?![0-9A-Za-z])"),
)
#: Words before a span that speak for its kind, and words that speak against any.
CUES = {
    "email": "mail|contact|write|reach|address|adresse|courriel|[ée]cri|joindre|correo|escrib|direcci|schreib|kontakt|erreich|anschrift",
    "ip": r"\bip\b|host|server|address|login|from|ping|serveur|h[ôo]te|connexion|adresse|servidor|conexi|direcci|desde|rechner|anmeld|verbind",
    "card": "card|visa|master|amex|credit|payment|pay|charge|carte|cr[ée]dit|paiement|tarjeta|pago|cobro|karte|zahl|abbuch|kredit",
    "phone": "phone|tel|call|mobile|fax|contact|reach|dial|ring|appel|joindre|portable|llam|m[óo]vil|anruf|handy|ruf|durchwahl",
    "secret": r"key|login|auth|bearer|credential|cl[ée]|secret|clave|contrase|schl[üu]ssel|kennwort|passwor",
}
AGAINST = r"\b(?:order|invoice|version|release|build|isbn|ean|sku|part|item|serial|ref|reference|tracking|parcel|commit|sha|md5|hash|digest|checksum|etag|id|uuid|section|chapter|figure|page|mac|took|rate|sum|commande|facture|num[ée]ro|pi[èe]ce|pedido|factura|parte|serie|bestellung|rechnung|auftrag|teil)\b"
CONTEXT = 24
FEATURES = ("kind", "digits", "size", "marks", "plus", "cue", "against", "left", "right", "shape", "luhn")
SIZES = (len(KINDS), 21, 16, 16, 2, 2, 2, 3, 3, 5, 2)
#: Labelled examples: # stands for a digit, ~ for a letter, ^ for a hexadecimal digit, | for a neutral word.
EXAMPLES = 6_000
TEMPLATES = {
    ("email", True): ("| mail ~~~~~.~~##[at]~~~~~.com |", "write to ~~~~~ (at) ~~~~~~ (dot) org |", "contact ~~~~~~ at ~~~~~~ dot net |", "| | ~~~~~[at]~~~~~[dot]de | |", "| ~~~~##[at]mail#.~~~~~.com |", "| reach ~~~~~@~~~~~~ or |", "e-mail: ~~~.~~~~@~~~~~~~, |", "my address is ~~~~ at ~~~~~~ dot com |"),
    ("email", False): ("| ~~~@~~ |", "| # @~~~ ~~~@# |", "| rate ~~@~~ |", "| ~~~~~ (at) ~~~~. ~~~~~ |", "| he looked at ~~~~ dot ~~~~ |", "the | stood at | dot |", "| part ~~~[at]~~.~~ |", "version ~~~@#.# |", "| ~~~~~~~~@~~ |"),
    ("ip", True): ("| from ##[.]##[.]1##[.]## |", "| 1##[.]#[.]#[.]## |", "server at #[.]##[.]1##[.]1## |", "ping 192.168.1.3## |", "host ##.3##.1##.## |", "| ip ##.###.##.5## |", "| ^^^^:^^^^:^^^^:^^^^:^^^^:^^^^:^^^^:^^^^ |", "login from ^^^^:^^^:^^^^:^:^^^^:^^:^^^^:^^^^"),
    ("ip", False): ("| version #.#.#.4## |", "release ##.#.###.9## |", "section #.##.#.8## |", "| 4##.6##.7##.9## |", "| build #.#.###.#### |", "| ##.####.##.### |", "| mac ^^:^^:^^:^^:^^:^^ |", "| ^^:^^:^^:^^:^^:^^ |", "| #:#:#:#:#:# |"),
    ("card", True): ("card 4############### |", "carte 5############### |", "credit 4### #### #### #### |", "paid by card 51##-####-####-#### |", "pay with 37############# |", "visa 4### #### #### #### |", "tarjeta 6011############ |", "kreditkarte 4############### |", "| charge 5### #### #### #### |"),
    ("card", False): ("order 4############### |", "| 1############### |", "| ############### ## 9################# |", "isbn 978#########4## |", "tracking 4### #### #### #### |", "| 16########### |", "| 17############### |", "parcel ref 4############### |", "| 9### #### #### #### |", "| 2################ |", "invoice 51##-####-####-#### |", "| 0################## |", "| 4############### |", "| 5############### |", "| 4### #### #### #### |", "| 51##-####-####-#### |", "| 37############# |", "| 6011############ |", "| | 4###############. |", "facture 4### #### #### #### |"),
    ("phone", True): ("call (###) ###-#### |", "| tel ###-###-#### |", "| phone: ### ### #### |", "| (###) ###-#### |", "fax ###.###.#### |", "| reach us +# ### ### ## |", "dial +## ### #### |", "mobile +######### |"),
    ("phone", False): ("order ###-###-#### |", "| part ### ### #### |", "sum ### ### #### |", "| ###.###.#### |", "| sku ###-###-#### |", "| ### ### #### |", "| took +###### |", "| +################### |", "| ref +####### |", "version +# ### ### |", "| ###-###-#### |"),
    ("secret", True): ("| password=^^^^^^^^^4a^^^^^^^^ |", "| password=" + "^" * 150 + "4a" + "^" * 150 + " |", "key " + "^" * 160 + " |", "cl\u00e9 ^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^ |", "clave ^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^ |", "schl\u00fcssel ^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^ |", "| password: ~~4#~~#~ |", "api_key = ~~~#~~~~##~~~~ |", "token=^^^^^^^^^^^^^^^^3b |", "| pwd: ~~~~##! |", "| AKIA7####A######B### |", "| sk-~~~~~~##~~~~~~~~~~##~~~~ |", "key ^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^ |", "auth bearer ^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^ |", "secret: ^^^^^^^^4f |"),
    ("secret", False): ("| password: required |", "password=**** |", "token: null |", "| the secret: ~~~~~~ |", "secret = ~~~~~~~~ |", "| token: ~~~~~ |", "pwd: <~~~~> |", "commit ^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^ |", "| md5 ^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^ |", "| ^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^ |", "password: ........ |", "api_key=<~~~_~~~> |"),
}
ROUNDS, DEPTH, RATE = 40, 4, 0.3
#: Share of true positives that a threshold must reach on held-out examples.
PRECISION = 0.95
#: Matches whose offsets are added up in one array, so that no list is copied whole for each of its items.
CHUNK = 256
SPAN = "struct<kind:int,start:int,stop:int,m:string,before:string,after:string>"
MARK = "struct<start:int,nstop:int,kind:int,sure:boolean,fits:boolean>"


def scan(xs: str, kind: str, first: str, step: str, item: str) -> str:
    """SQL for the items made from the column ``xs`` in order, each from the element ``x`` and the state ``s`` before it."""
    inner = f"aggregate(part, named_struct('s', acc.s, 'o', cast(array() as array<{kind}>)), (a, x) -> named_struct('s', {step.replace('$', 'a.s')}, 'o', array_append(a.o, {item.replace('$', 'a.s')})))"
    parts = f"transform(sequence(0, greatest(size({xs}) - 1, 0) div {CHUNK}), k -> slice({xs}, cast(k as int) * {CHUNK} + 1, {CHUNK}))"
    return f"""flatten(aggregate({parts}, named_struct('s', {first}, 'o', cast(array() as array<array<{kind}>>)),
      (acc, part) -> element_at(transform(array({inner}), r -> named_struct('s', r.s, 'o', array_append(acc.o, r.o))), 1), acc -> acc.o))"""


def _spans(docs: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``docs`` with columns ``x0, x1, ...``: for each rule the leftmost non-overlapping matches in ``text``, with offsets in code points."""
    n, none = range(len(rules)), "cast(array() as array<string>)"
    docs = docs.withColumns({f"m{k}": F.expr(f"if({quick}, regexp_extract_all(text, r'{pattern}', 0), {none})") for k, (_, quick, pattern) in enumerate(rules)})
    docs = docs.withColumns({f"a{k}": F.expr(f"if(size(m{k}) > 0, split(text, r'{pattern}', -1), {none})") for k, (_, _, pattern) in enumerate(rules)})
    docs = docs.withColumns({f"z{k}": F.expr(f"transform(m{k}, (m, i) -> named_struct('m', m, 'before', a{k}[i], 'after', a{k}[i + 1]))") for k in n})
    start = "$ + length(x.before)"
    item = f"named_struct('kind', {{}}, 'start', {start}, 'stop', {start} + length(x.m), 'm', x.m, 'before', right(x.before, {CONTEXT}), 'after', left(x.after, 1))"
    found = {f"x{k}": F.expr(scan(f"z{k}", SPAN, "0", f"{start} + length(x.m)", item.format(KINDS.index(kind)))) for k, (kind, _, _) in enumerate(rules)}
    return docs.withColumns(found).drop(*(f"{c}{k}" for c in "maz" for k in n))


def _side(character: str) -> str:
    return f"case when {character} rlike '[\\\\p{{L}}\\\\p{{N}}]' then 2 when {character} rlike '\\\\S' then 1 else 0 end"


def _features() -> str:
    """SQL for the features of ``x``, without the check of its kind."""
    cue = " ".join(f"when x.kind = {k} then lower(x.before) rlike r'{CUES[name]}'" for k, name in enumerate(KINDS))
    digits = "regexp_replace(x.m, '[^0-9]', '')"
    value = "regexp_extract(x.m, '[=:] ?(.*)$', 1)"
    shape = f"""case x.kind
      when 0 then case when x.m like '%@%' then 0 when x.m rlike '[\\\\[(]' then 1 else 2 end
      when 1 then case when x.m like '%:%' then 2 when exists(split({digits.replace("'[^0-9]', ''", "'[^0-9]+', ','")}, ','), p -> length(p) > 3 or cast(concat('0', p) as int) > 399) then 0 when x.m like '%[%' then 3 else 1 end
      when 2 then if({digits} rlike '^(?:3[47][0-9]{{13}}|4[0-9]{{15}}|5[1-5][0-9]{{14}}|6(?:011|5[0-9]{{2}})[0-9]{{12}})$', 1, 0)
      when 3 then case when x.m like '+%' then 1 when x.m like '(%' then 2 else 0 end
      else case when x.m not rlike '[=:]' then if(x.m rlike '^[0-9a-f]+$', 3, 2) when {value} rlike '[0-9]' and {value} rlike '[A-Za-z]' then 1 when {value} rlike '^[A-Za-z]+$' then 0 else 4 end end"""
    return f"""
    'kind', x.kind, 'digits', least(length({digits}), 20), 'size', least(length(x.m) div 4, 15),
    'marks', if(x.m like '% %', 1, 0) + if(x.m like '%-%', 2, 0) + if(x.m like '%.%', 4, 0) + if(x.m rlike r'[(\\[]', 8, 0),
    'plus', if(x.m like '+%', 1, 0), 'cue', if(case {cue} end, 1, 0), 'against', if(lower(x.before) rlike r'{AGAINST}', 1, 0),
    'left', {_side("right(x.before, 1)")}, 'right', {_side("x.after")}, 'shape', {shape}, 'luhn', if(case when x.kind = 2 then {LUHN} end, 1, 0)"""


def candidates(docs: DataFrame, id_column: str, text: str, *keep: str) -> DataFrame:
    """``id``, ``base`` spans (``start, kind, stop``) in order, and ``proposed`` ones with their features, beside the columns in ``keep``."""
    out = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *keep)
    out = _spans(out, [(kind, quick, pattern) for kind, quick, pattern, _ in BASE] + list(PROPOSED))
    base = ", ".join(f"transform(filter(x{k}, x -> {check}), x -> named_struct('start', x.start, 'kind', x.kind, 'stop', x.stop))" for k, (_, _, _, check) in enumerate(BASE))
    proposed = ", ".join(f"x{len(BASE) + k}" for k in range(len(PROPOSED)))
    return out.select("id", *keep, F.expr(f"array_sort(concat({base}))").alias("base"), F.expr(f"transform(concat({proposed}), x -> named_struct('start', x.start, 'stop', x.stop, {_features()}))").alias("proposed"))


# boosted trees -----------------------------------------------------------------


def _tree(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, depth: int) -> tuple:
    """A regression tree on small whole-number features: a leaf value, or (feature, largest value to the left, left, right)."""
    g, h = gradient.sum(), hessian.sum()
    leaf = ("leaf", float(-g / (h + 1)))
    if depth == 0 or len(x) < 2:
        return leaf
    best, found = 1e-6, None
    for j in range(x.shape[1]):
        gs, hs = (np.bincount(x[:, j], w, SIZES[j]).cumsum() for w in (gradient, hessian))
        gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
        gain[(hs < 1) | (h - hs < 1)] = 0
        k = int(gain.argmax())
        if gain[k] > best:
            best, found = gain[k], (j, k)
    if not found:
        return leaf
    left = x[:, found[0]] <= found[1]
    return (*found, _tree(x[left], gradient[left], hessian[left], depth - 1), _tree(x[~left], gradient[~left], hessian[~left], depth - 1))


def _value(tree: tuple, x: np.ndarray) -> np.ndarray:
    if tree[0] == "leaf":
        return np.full(len(x), tree[1])
    left = x[:, tree[0]] <= tree[1]
    out = np.empty(len(x))
    out[left], out[~left] = _value(tree[2], x[left]), _value(tree[3], x[~left])
    return out


class Boosted:
    """Trees, and for each kind the least score that is redacted, with its precision and recall on held-out examples."""

    def __init__(self, x: np.ndarray, positive: np.ndarray, negative: np.ndarray, held_positive: np.ndarray, held_negative: np.ndarray) -> None:
        score, self.trees = np.zeros(len(x)), []
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-score))
            tree = _tree(x, (positive + negative) * p - positive, (positive + negative) * p * (1 - p), DEPTH)
            self.trees.append(tree)
            score += RATE * _value(tree, x)
        rules = [self._threshold(score[own], held_positive[own], held_negative[own]) for own in (x[:, 0] == k for k in range(len(KINDS)))]
        self.least, self.precision, self.recall = zip(*rules, strict=True)

    @staticmethod
    def _threshold(score: np.ndarray, positive: np.ndarray, negative: np.ndarray) -> tuple[float, float, float]:
        found, order = (math.inf, 1.0, 0.0), np.argsort(-score, kind="stable")
        good, bad = positive[order].cumsum(), negative[order].cumsum()
        for k in range(len(order)):
            last = k + 1 == len(order) or score[order[k + 1]] < score[order[k]]
            if last and good[k] > 0 and good[k] >= PRECISION * (good[k] + bad[k]):
                found = float(score[order[k]]), float(good[k] / (good[k] + bad[k])), float(good[k] / good[-1])
        return found

    def selected(self, x: str = "x") -> str:
        """SQL that holds for a proposal to redact. A margin keeps the two additions' rounding apart."""

        def case(tree: tuple) -> str:
            if tree[0] == "leaf":
                return f"{RATE * tree[1]:.12f}D"
            return f"if({x}.{FEATURES[tree[0]]} <= {tree[1]}, {case(tree[2])}, {case(tree[3])})"

        least = ", ".join("double('infinity')" if v == math.inf else f"{v - 1e-9:.12f}D" for v in self.least)
        return f"({' + '.join(map(case, self.trees))}) >= element_at(array({least}), {x}.kind + 1)"


def examples(spark: SparkSession, n: int = EXAMPLES) -> DataFrame:
    """``id, kind, positive, text``: ``n`` labelled examples, the same in any session."""
    made = [(KINDS.index(kind), label, t) for (kind, label), ts in TEMPLATES.items() for t in ts]
    listed = ", ".join("named_struct('kind', {}, 'positive', {}, 'text', r'{}')".format(k, str(label).lower(), t) for k, label, t in made)
    pick = lambda letters, salt: f"substr('{letters}', 1 + cast(pmod(xxhash64(id, i, {salt}), {len(letters)}) as int), 1)"
    word = "concat(" + ", ".join(pick("abcdefghijklmnoprstuvwy", s) for s in range(10, 15)) + ")"
    drawn = f"array_join(transform(split(t.text, ''), (c, i) -> case c when '#' then {pick('0123456789', 1)} when '~' then {pick('abcdefghijklmnoprstuvwy', 2)} when '^' then {pick('0123456789abcdef', 3)} when '|' then {word} else c end), '')"
    return spark.range(0, n, 1, 4).withColumn("t", F.expr(f"element_at(array({listed}), 1 + cast(id % {len(made)} as int))")).select("id", "t.kind", "t.positive", F.expr(drawn).alias("text"))


@functools.lru_cache(4)
def fit(spark: SparkSession) -> Boosted:
    """Trees and thresholds from the examples; half of them, by a hash, teach the trees and half the thresholds."""
    found = candidates(examples(spark).withColumnRenamed("kind", "own"), "id", "text", "own", "positive")
    one = found.select((F.pmod(F.xxhash64("id"), F.lit(2)) == 1).alias("held"), "own", "positive", F.explode_outer("proposed").alias("x")).where("x.kind = own")  # outer: else the list is made twice, for a filter of empty ones
    counts = (F.count_if(F.col("positive").eqNullSafe(p) & F.col("held").eqNullSafe(h)).alias(n) for n, p, h in (("p", True, False), ("n", False, False), ("hp", True, True), ("hn", False, True)))
    rows = one.groupBy(*(F.col(f"x.{f}").alias(f) for f in FEATURES)).agg(*counts).orderBy(*FEATURES).collect()  # at most a few of each example
    x = np.array([[r[f] for f in FEATURES] for r in rows], np.int64).reshape(len(rows), len(FEATURES))
    return Boosted(x, *(np.array([r[k] for r in rows], np.float64) for k in ("p", "n", "hp", "hn")))


def personal_data(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, base, spans`` for every row: arrays of ``struct<start, kind, stop>`` in order.

    ``kind`` counts ``KINDS``; offsets are code points, ends exclusive. Null and
    empty texts have none. Base spans always stay, even where kinds overlap. A
    selected proposal that overlaps a base span, or a selected proposal that
    begins before it (of equal starts, the longer), is left out. Repeated rows
    and ids keep a row each; other columns are not read.
    """
    model = fit(docs.sparkSession)
    found = candidates(docs, id_column, text)
    sure = "transform(base, x -> named_struct('start', x.start, 'nstop', -x.stop, 'kind', x.kind, 'sure', true, 'fits', true))"
    more = f"transform(filter(proposed, x -> {model.selected()}), x -> named_struct('start', x.start, 'nstop', -x.stop, 'kind', x.kind, 'sure', false, 'fits', true))"
    marks = found.select("id", "base", F.expr(f"array_sort(concat({sure}, {more}))").alias("marks"))
    # forwards: no base span and no proposal before it reaches in; backwards: no base span begins within
    item = "named_struct('start', x.start, 'nstop', x.nstop, 'kind', x.kind, 'sure', x.sure, 'fits', {})"
    ahead = scan("marks", MARK, "0", "greatest($, -x.nstop)", item.format("x.sure or x.start >= $"))
    back = scan("marks", MARK, "2147483647", "if(x.sure, x.start, $)", item.format("x.sure or (x.fits and -x.nstop <= $)"))
    marks = marks.withColumn("marks", F.expr(ahead)).withColumn("marks", F.reverse("marks")).withColumn("marks", F.expr(back))
    return marks.select("id", "base", F.expr("array_sort(transform(filter(marks, x -> x.fits), x -> named_struct('start', x.start, 'kind', x.kind, 'stop', -x.nstop)))").alias("spans"))


def described(spans: str) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, s -> concat(array({names})[s.kind], ':', s.start, ':', s.stop)), ',')")


def redacted(docs: DataFrame, spans: DataFrame, id_column: str = "doc_id", text: str = "text", mark: str = "[{}]") -> DataFrame:
    """Documents with their spans replaced by the kind's mark; ``spans`` comes from ``personal_data``, ids unique.

    A span that begins within the one before it is covered by that one's mark, as far as it reaches.
    """
    marks = ", ".join(f"'{mark.format(k)}'" for k in KINDS)
    key, own = fresh(docs, "_id"), fresh(docs, "_spans")
    joined = docs.join(spans.select(F.col("id").alias(key), F.col("spans").alias(own)), F.col(id_column) == F.col(key), "left")
    joined = joined.withColumn(own, F.coalesce(own, F.expr("cast(array() as array<struct<start:int,kind:int,stop:int>>)")))
    pieces = scan(own, "string", "0", "greatest($, x.stop)", f"if(x.start < $, '', concat(substring(`{text}`, $ + 1, x.start - $), array({marks})[x.kind]))")
    rest = f"substring(`{text}`, 1 + coalesce(array_max(transform(`{own}`, x -> x.stop)), 0))"
    return joined.withColumn(text, F.when(F.col(text).isNotNull(), F.concat(F.array_join(F.expr(pieces), ""), F.expr(rest)))).select(*docs.columns)
