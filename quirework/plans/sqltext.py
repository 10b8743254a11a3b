"""SQL fragments shared by the checking queries."""


def fixed(n: str, unit: int, digits: int) -> str:
    if digits == 0:
        return f"cast((({n}) + {unit // 2}) // {unit} AS varchar)"
    scale = 10 ** digits
    q = f"((({n}) * {scale} + {unit // 2}) // {unit})"
    return f"(cast({q} // {scale} AS varchar) || '.' || lpad(cast({q} % {scale} AS varchar), {digits}, '0'))"


KB, MB, GB = 1024, 1048576, 1073741824


def fmt_bytes(n: str, precise: bool = False) -> str:
    kb = fixed(n, KB, 1) if precise else f"CASE WHEN {n} < {10 * KB} THEN {fixed(n, KB, 1)} ELSE {fixed(n, KB, 0)} END"
    mb = fixed(n, MB, 2) if precise else f"CASE WHEN {n} < {10 * MB} THEN {fixed(n, MB, 2)} ELSE {fixed(n, MB, 1)} END"
    return (f"CASE WHEN {n} IS NULL OR {n} < 0 THEN '—' WHEN {n} < {KB} THEN ({n}) || ' bytes' WHEN {n} < {MB} THEN ({kb}) || ' KB' "
            f"WHEN {n} < {GB} THEN ({mb}) || ' MB' ELSE {fixed(n, GB, 2)} || ' GB' END")


def readout(n: str) -> str:
    return f"CASE WHEN {n} < {KB} THEN ({n}) || ' bytes' WHEN {n} < {MB} THEN {fixed(n, KB, 1)} || ' KB' ELSE {fixed(n, MB, 1)} || ' MB' END"


def error_bytes(n: str) -> str:
    return f"CASE WHEN {n} < {GB} THEN {readout(n)} ELSE {fixed(n, GB, 2)} || ' GB' END"


def plural(n: str, one: str, many: str | None = None) -> str:
    return f"(format('{{:,}}', {n}) || ' ' || CASE WHEN {n} = 1 THEN '{one}' ELSE '{many or one + 's'}' END)"


def r6(x: str) -> str:
    return f"cast(floor(({x}) * 1000000.0 + 0.5) AS bigint)"


def js_round(x: str) -> str:
    return f"cast(floor(({x}) + 0.5) AS bigint)"


def page_name(w: str, h: str) -> str:
    lo, hi = f"least({w}, {h})", f"greatest({w}, {h})"
    sizes = [("A4", 595, 842), ("Letter", 612, 792), ("Legal", 612, 1008), ("A3", 842, 1191), ("A5", 420, 595)]
    whens = " ".join(f"WHEN abs({lo} - {a}) < 3 AND abs({hi} - {b}) < 3 THEN '{n}'" for n, a, b in sizes)
    mm = lambda v: f"cast(floor({v} / 72.0 * 25.4 + 0.5) AS bigint)"
    return f"CASE {whens} ELSE {mm(lo)} || '×' || {mm(hi)} || ' mm' END"


TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
BODY = r"regexp_replace(regexp_replace(html, '<script[\s\S]*?</script>|<style[\s\S]*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')"


def normalise(t: str) -> str:
    for name, char in [("nbsp", " "), ("mdash", "—"), ("ndash", "–"), ("middot", "·"), ("hellip", "…"), ("rsquo", "’"), ("lsquo", "‘"),
                       ("rdquo", "”"), ("ldquo", "“"), ("times", "×"), ("rarr", "→"), ("larr", "←"), ("copy", "©")]:
        t = f"replace({t}, '&{name};', '{char}')"
    t = f"replace({t}, '&apos;', '''')"
    for e, c in [("quot", '"'), ("lt", "<"), ("gt", ">"), ("amp", "&")]:
        t = f"replace({t}, '&{e};', '{c}')"
    return f"regexp_replace(translate({t}, '‘’“”', '''''\"\"'), '\\s+', ' ', 'g')"
