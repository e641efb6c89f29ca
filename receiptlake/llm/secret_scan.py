"""Secret scans with a randomness test battery, in DataFrame expressions only.

Three fixed shapes are always reported: values assigned to a secret's name, access keys and
long lower-case hex runs. Beyond them, every other run of 20 or more key characters that
mixes letters and digits is a candidate. Its encoding is inferred (base 16, 32, 36, 62 or
64), and over that alphabet it takes three tests of randomness: chi-squared for uniformity
over eight equal parts, runs above and below the middle, and lag-1 serial correlation. The
three p-values are combined by Fisher's method; a candidate that fails them is no key. What
passes must also be unlikely as text: the ratio of its chance under the alphabet to that
under a model of text that seldom changes between lower case, upper case, digits and signs
is an e-value, which grows with length, and its inverse a p-value. These are controlled
for false discovery over the candidates of a document (step-up at ``q``).

Null texts count as empty and have no spans. Positions are code points, ends exclusive.
Repeated rows are scanned row by row; other columns pass through ``redact`` untouched and
are left out by ``secret_spans``.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The shapes to report, in the order of their kinds.
ASSIGN = (
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"
    r"|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ASSIGN_VALUE = 12
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")

_KEY = "A-Za-z0-9+/_-"
CANDIDATE = (
    f"(?<![{_KEY}])(?=[{_KEY}]*[0-9])(?=[{_KEY}]*[A-Za-z])[{_KEY}]{{20,}}(?![{_KEY}])={{0,2}}"
)
_SPANS = "array<struct<s:bigint,k:int,e:bigint>>"

# Characters of a text that are gone through at a time.
STRETCH = 8192

# Alphabet of each inferred encoding, first match wins. The sign classes share 62 and 63.
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = (
    ("^[0-9A-F]+$", _DIGITS + _UPPER[:6]),
    ("^[A-Z2-7]+$", _UPPER + "234567"),
    ("^[0-9a-z]+$", _DIGITS + _LOWER),
    ("^[0-9A-Z]+$", _DIGITS + _UPPER),
    ("^[0-9A-Za-z]+$", _DIGITS + _UPPER + _LOWER),
    ("", _DIGITS + _UPPER + _LOWER + "+/"),
)

# The text model: it stays in its class of characters nine times out of ten.
_STAY = 0.9


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _prefix_sums(sizes: str) -> str:
    """Sums of all elements before each one. Blocks of 256 keep the appending cheap."""
    start = "struct(0L AS n, CAST(array() AS array<bigint>) AS a)"
    block = f"aggregate(b, {start}, (x, v) -> struct(x.n + v AS n, concat(x.a, array(x.n)) AS a))"
    blocks = f"transform(sequence(0, (size(z) - 1) DIV 256), i -> slice(z, i * 256 + 1, 256))"
    sums = (
        f"aggregate(transform({blocks}, b -> {block}), {start}, (x, v) -> "
        "struct(x.n + v.n AS n, concat(x.a, transform(v.a, p -> p + x.n)) AS a)).a"
    )
    return f"transform(array({sizes}), z -> {sums})[0]"


def _matches(pattern: str, kind: int, screen: str, group: int = 0) -> str:
    """Structs (s, e, t: text of ``group``) of all matches. Between the matches stand the
    pieces of a split, so lengths alone give the positions."""
    p = _sql(pattern)
    steps = (
        f"zip_with(slice(split(text, {p}), 1, size(m)), m, "
        "(g, t) -> struct(bigint(length(g)) AS g, bigint(length(t)) AS n))"
    )
    sums = _prefix_sums("transform(w, v -> v.g + v.n)")
    spans = (
        f"transform(array({steps}), w -> zip_with(w, {sums}, "
        f"(v, p) -> struct(p + v.g AS s, {kind} AS k, p + v.g + v.n AS e)))[0]"
    )
    texts = "m" if group == 0 else f"regexp_extract_all(text, {p}, {group})"
    found = f"transform(array(regexp_extract_all(text, {p}, 0)), m -> zip_with({spans}, {texts}, (a, t) -> struct(a.s AS s, a.k AS k, a.e AS e, t AS t)))[0]"
    none = "CAST(array() AS array<struct<s:bigint,k:int,e:bigint,t:string>>)"
    return f"CASE WHEN rlike(text, {_sql(screen)}) THEN {found} ELSE {none} END"


def _p_normal(z: str) -> str:
    """Two-sided p-value of a normal deviate."""
    return f"transform(array(abs({z})), z -> 2 / (1 + exp(1.5976 * z + 0.07056 * z * z * z)))[0]"


def _tests() -> list[str]:
    """Steps, each a list of new fields of a candidate c; later ones use earlier ones."""
    alphabet = "CASE " + " ".join(
        f"WHEN rlike(c.t, {_sql(p)}) THEN {_sql(a)}" for p, a in ENCODINGS
    ) + " END"
    half = "c.size / 2"
    mean = "(aggregate(c.x, 0D, (a, v) -> a + v) / c.n)"
    counts = (
        "transform(sequence(0, 7), b -> size(filter(c.x, v -> int(v * 8 / c.size) = b)) "
        "- c.n * (ceil((b + 1) * c.size / 8D) - ceil(b * c.size / 8D)) / c.size)"
    )
    expected = "(c.n * (ceil((i + 1) * c.size / 8D) - ceil(i * c.size / 8D)) / c.size)"
    lag = "zip_with(slice(c.x, 1, c.n - 1), slice(c.x, 2, c.n - 1), (a, b) -> (a - c.mean) * (b - c.mean))"
    deviation = "pow(c.chi / 7, 1 / 3D) - (1 - 2 / 63D)"
    low, high = "c.low", "(c.n - c.low)"
    expect_runs = f"(2D * {low} * {high} / c.n + 1)"
    spread = f"greatest(({expect_runs} - 1) * ({expect_runs} - 2) / (c.n - 1), 1e-9)"
    classes = "[0-9]+|[a-z]+|[A-Z]+|[^0-9A-Za-z]+"
    digits, lower = "size(regexp_extract_all(c.t, '[0-9]', 0))", "size(regexp_extract_all(c.t, '[a-z]', 0))"
    upper = "size(regexp_extract_all(c.t, '[A-Z]', 0))"
    sizes = f"({digits} * ln(10D) + ({lower} + {upper}) * ln(26D) + (c.n - {digits} - {lower} - {upper}) * ln(2D))"
    return [
        f"regexp_replace(translate(c.t, '-_', '+/'), '=+$', '') AS t",
        f"{alphabet} AS alphabet",
        "length(c.alphabet) AS size, length(c.t) AS n, "
        "transform(regexp_extract_all(c.t, '.', 0), v -> instr(c.alphabet, v) - 1) AS x, "
        f"size(regexp_extract_all(c.t, '{classes}', 0)) - 1 AS changes",
        f"{mean} AS mean, size(filter(c.x, v -> v < {half})) AS low, "
        f"aggregate(zip_with(slice(c.x, 1, c.n - 1), slice(c.x, 2, c.n - 1), (a, b) -> IF((a < {half}) != (b < {half}), 1, 0)), 1, (a, v) -> a + v) AS runs, "
        f"aggregate(transform({counts}, (d, i) -> d * d / {expected}), 0D, (a, v) -> a + v) AS chi",
        f"aggregate({lag}, 0D, (a, v) -> a + v) / greatest(aggregate(c.x, 0D, (a, v) -> a + (v - c.mean) * (v - c.mean)), 1e-9) AS serial",
        f"1 / (1 + exp(1.5976 * ({deviation}) / sqrt(2 / 63D) + 0.07056 * pow(({deviation}) / sqrt(2 / 63D), 3))) AS p_uniform, "
        f"{_p_normal(f'(c.runs - {expect_runs}) / sqrt({spread})')} AS p_runs, "
        f"{_p_normal('c.serial * sqrt(double(c.n))')} AS p_serial",
        "-ln(greatest(c.p_uniform, 1e-12)) - ln(greatest(c.p_runs, 1e-12)) - ln(greatest(c.p_serial, 1e-12)) AS fisher, "
        # ln P(text) - ln P(random): stays and changes of class, then a letter of the class
        f"(c.n - 1 - c.changes) * ln({_STAY}D) + c.changes * ln({(1 - _STAY) / 3}D) - ln(4D) - {sizes} + c.n * ln(double(c.size)) AS log_p",
        "exp(-c.fisher) * (1 + c.fisher + c.fisher * c.fisher / 2) AS p_random",
    ]


def _with_fields(column: str, fields: list[str]) -> str:
    known, out = ["s", "k", "e", "t"], column
    for step in fields:
        names = [part.rsplit(" ", 1)[1] for part in _split_fields(step)]
        kept = [n for n in known if n not in names]
        out = f"transform({out}, c -> struct({', '.join(f'c.{n} AS {n}' for n in kept)}, {step}))"
        known = [*kept, *names]
    return out


def _split_fields(step: str) -> list[str]:
    """Top-level, comma-separated parts of a list of expressions."""
    parts, depth, quoted, last = [], 0, False, 0
    for n, c in enumerate(step):
        quoted ^= c == "'"
        depth += 0 if quoted else (c in "([") - (c in ")]")
        if c == "," and not depth and not quoted:
            parts.append(step[last:n])
            last = n + 1
    return [*parts, step[last:]]


def with_spans(docs: DataFrame, text: Column, q: float, alpha: float) -> DataFrame:
    """All columns, and __base and __spans: arrays of (s, k, e), k an index of KINDS."""
    plain = "transform({}, x -> struct(x.s AS s, x.k AS k, x.e AS e))"
    assign = f"filter({_matches(ASSIGN, 0, ASSIGN, 2)}, x -> length(x.t) >= {ASSIGN_VALUE})"
    access, hexes = _matches(ACCESS, 1, ACCESS), _matches(HEX, 2, HEX)
    tested = _with_fields("__candidates", _tests())
    random = f"filter({tested}, c -> c.p_random >= {alpha}D AND c.log_p < 0)"
    # Step-up over m candidates: the largest r with p_(r) <= r q / m; m counts those tested.
    ranked = "array_sort(transform(__random, c -> c.log_p))"
    bound = f"array_max(transform({ranked}, (p, i) -> IF(p <= ln((i + 1) * {q}D / __tested), p, NULL)))"
    out = docs.withColumn("__text", F.coalesce(text, F.lit("")))
    at = lambda sql: F.expr(sql.replace("(text,", "(__text,"))
    out = out.withColumn(
        "__base",
        F.sort_array(
            F.concat(*(at(plain.format(x)).cast(_SPANS) for x in (assign, access, hexes)))
        ),
    )
    # A candidate is held against the spans of its own stretch of text only.
    near = (
        f"transform(sequence(0L, (length(__text) - 1) DIV {STRETCH}), "
        f"i -> filter(__base, b -> b.s < (i + 1) * {STRETCH} AND b.e > i * {STRETCH}))"
    )
    own = f"slice(z, int(c.s DIV {STRETCH}) + 1, int((c.e - 1) DIV {STRETCH} - c.s DIV {STRETCH}) + 1)"
    apart = f"c -> NOT exists({own}, n -> exists(n, b -> b.s < c.e AND b.e > c.s))"
    candidates = _matches(CANDIDATE, 3, CANDIDATE).replace("(text,", "(__text,")
    out = out.withColumn("__candidates", F.expr(f"transform(array({near}), z -> filter({candidates}, {apart}))[0]"))
    out = out.withColumn("__tested", F.size("__candidates")).withColumn("__random", F.expr(random))
    out = out.withColumn("__bound", F.expr(f"CASE WHEN size(__random) > 0 THEN {bound} END"))
    found = plain.format("filter(__random, c -> c.log_p <= __bound)")
    out = out.withColumn("__spans", F.sort_array(F.concat("__base", F.expr(found).cast(_SPANS))))
    return out.drop("__text", "__candidates", "__tested", "__random", "__bound")


def _joined(column: str) -> Column:
    kinds = "array(" + ", ".join(_sql(k) for k in KINDS) + ")"
    return F.expr(
        f"array_join(transform({column}, x -> concat_ws(':', {kinds}[x.k], x.s, x.e)), ',')"
    )


def secret_spans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    q: float = 0.01,
    alpha: float = 0.001,
) -> DataFrame:
    """Columns ``id_col``, n_assign, n_access, n_hex, n_random, base (spans of the fixed
    shapes) and spans (all), as kind:start:end joined by commas, in order of start."""
    found = with_spans(docs.select(F.col(id_col), F.col(text_col)), F.col(text_col), q, alpha)
    counts = [
        F.expr(f"bigint(size(filter(__spans, x -> x.k = {n})))").alias(f"n_{kind}")
        for n, kind in enumerate(KINDS)
    ]
    return found.select(id_col, *counts, _joined("__base").alias("base"), _joined("__spans").alias("spans"))


def redact(
    docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]", q: float = 0.01, alpha: float = 0.001
) -> DataFrame:
    """The rows with every span replaced by ``mask``; overlapping spans give one mask.
    Null texts stay null, texts without spans stay as they are."""
    found = with_spans(docs, F.col(text_col), q, alpha)
    name = f"`{text_col}`"
    # Stretch by stretch, so the work on the text grows with it and not with its square. A
    # span that began before a stretch is masked there. What the steps need of a stretch is in
    # their state: Spark takes no Python function of an expression whose inner lambdas look
    # outside.
    step = (
        "(a, x) -> CASE WHEN x.e <= a.at OR x.s >= a.high THEN a ELSE struct("
        f"concat(a.out, IF(x.s >= a.at, concat(substring(a.p, int(a.at - a.low + 1), int(x.s - a.at)), {_sql(mask)}), '')) AS out, "
        "x.e AS at, a.low AS low, a.high AS high, a.p AS p) END"
    )
    state = f"struct('' AS out, i * {STRETCH}L AS at, i * {STRETCH}L AS low, (i + 1) * {STRETCH}L AS high, p AS p)"
    rest = "a -> concat(a.out, substring(a.p, int(a.at - a.low + 1)))"
    stretch = f"aggregate(__spans, {state}, {step}, {rest})"
    pieces = f"regexp_extract_all({name}, '(?s).{{1,{STRETCH}}}', 0)"
    masked = f"array_join(transform({pieces}, (p, i) -> {stretch}), '')"
    masked = F.expr(f"CASE WHEN size(__spans) > 0 THEN {masked} ELSE {name} END")
    return found.withColumn(text_col, masked).drop("__base", "__spans")
