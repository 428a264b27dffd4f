"""The gates a file passes before it is indexed, as columns, and their driver-side twins for the tree walker.

The first gate that closes gives the reason, so their order matters. Whatever is rejected stays out of
every result, message and report.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_FILE_BYTES = 1 << 20
HEADER_BYTES = 4 << 10

# Names and suffixes that are never read.
SECURITY_FOLDERS = (
    ".git", ".github", ".gitlab", ".circleci", ".azure", ".aws", ".ssh", ".gnupg", ".kube",
    ".tessera", ".idea", ".vscode", ".devcontainer", ".terraform", ".serverless",
)
BUILD_FOLDERS = (
    "node_modules", "vendor", ".venv", "venv", "__pycache__", ".pytest_cache", ".mypy_cache",
    ".ruff_cache", ".cache", ".next", ".nuxt", ".svelte-kit", "dist", "build", "out", "target",
    "coverage", "tmp", "temp", "Pods", ".gradle", ".dart_tool", ".pub-cache", "DerivedData",
    "Carthage", ".cxx", ".expo", ".turbo", ".nx", ".parcel-cache", ".vite", ".bundle",
)
SECURITY_NAMES = (
    ".git", ".npmrc", ".pypirc", ".netrc", ".htpasswd", "authorized_keys", "known_hosts", "jenkinsfile",
    ".travis.yml", "azure-pipelines.yml", "bitbucket-pipelines.yml", "renovate.json", "dependabot.yml",
)
SECURITY_SUFFIXES = (".pem", ".key", ".p12", ".pfx", ".crt", ".cer", ".der", ".jks", ".keystore", ".kdbx", ".asc", ".gpg")
SECRET_STEMS = ("credentials", "secret", "secrets")
SECRET_KEYS = ("token", "password", "secret", "api_key", "apikey")
PEM_MARKERS = ("PRIVATE KEY", "RSA PRIVATE KEY", "EC PRIVATE KEY", "OPENSSH PRIVATE KEY")
CREDENTIALS = (r"(?:AKIA|ASIA)[A-Z0-9]{16}", r"AIza[0-9A-Za-z_-]{35}", r"gh[pousr]_[0-9A-Za-z]{20,}", r"xox[baprs]-[0-9A-Za-z-]{10,}")
# Extensions of unsupported files that a report names; others are counted together.
KNOWN_EXTENSIONS = (
    ".bash", ".c", ".cc", ".cpp", ".cs", ".css", ".csv",
    ".go", ".h", ".hpp", ".html", ".java", ".js", ".jsx",
    ".json", ".kt", ".kts", ".less", ".log", ".lua", ".md",
    ".php", ".rb", ".rs", ".sass", ".scala", ".scss", ".sh",
    ".sql", ".swift", ".toml", ".txt", ".vue", ".xml", ".yaml",
    ".yml", ".zsh",
    ".dart", ".m", ".mm", ".gradle", ".properties", ".lock",
    ".podspec", ".xcconfig", ".pbxproj", ".plist", ".storyboard", ".xib",
    ".graphql", ".gql", ".proto", ".svelte", ".astro", ".pyi",
    ".svg", ".png", ".jpg", ".jpeg", ".gif", ".webp", ".avif",
    ".bmp", ".ico", ".tif", ".tiff",
    ".ttf", ".otf", ".woff", ".woff2", ".eot",
    ".zip", ".tar", ".gz", ".tgz", ".bz2", ".xz", ".7z",
    ".rar", ".jar", ".war", ".aar", ".apk", ".ipa",
    ".so", ".dylib", ".dll", ".a", ".lib", ".o", ".obj",
    ".exe", ".bin", ".wasm",
)

_ESCAPED = lambda names: "|".join(re.escape(n.lower()) for n in names)
#: (reason, pattern) of lower-cased names, in order; the first two apply to folders as well.
_FOLDER_GATES = (("security", rf"^(?:{_ESCAPED(SECURITY_FOLDERS)})\z"), ("dependency_build_cache", rf"^(?:{_ESCAPED(BUILD_FOLDERS)})\z"))
_NAME_GATES = (
    ("security", rf"^(?:{_ESCAPED(SECURITY_NAMES)})\z|^\.env(?:\z|\.)|^(?:{_ESCAPED(SECRET_STEMS)})(?:\z|\.)|^id_rsa|^id_ed25519"),
    ("security", rf"(?:{_ESCAPED(SECURITY_SUFFIXES)}|\.tfstate)\z|\.tfstate\."),
    ("generated", r"\.min\.|\.map\z|\.generated\.|\.gen\."),
)


# --- names ---------------------------------------------------------------------------------------


def name_reason(name: Column, folder: Column) -> Column:
    """Why an entry's name keeps it out; null if it doesn't."""
    low = F.lower(name)
    gates = [F.when(low.rlike(p), reason) for reason, p in _FOLDER_GATES]
    gates += [F.when(~folder & low.rlike(p), reason) for reason, p in _NAME_GATES]
    return F.coalesce(*gates)


def name_reason_of(name: str, folder: bool) -> str | None:
    low = name.lower()
    gates = _FOLDER_GATES if folder else _FOLDER_GATES + _NAME_GATES
    return next((reason for reason, p in gates if re.search(p.replace(r"\z", r"\Z"), low)), None)


def unsupported_bucket(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"(\.[^./]*)\z", 1))
    return F.when(extension == "", "<none>").when(extension.isin(*KNOWN_EXTENSIONS), extension).otherwise("<other>")


# --- content -----------------------------------------------------------------------------------


def generated_header(text: Column) -> Column:
    head = F.lower(F.substring(text.cast("binary"), 1, HEADER_BYTES).cast("string"))
    return head.contains("code generated") & head.contains("do not edit")


def pem_marker(text: Column) -> Column:
    upper = F.upper(text)
    found = F.lit(False)
    for kind in PEM_MARKERS:
        found = found | upper.contains(f"-----BEGIN {kind}-----")
    return found


def credential(text: Column) -> Column:
    """Known shapes of keys, with borders between ASCII word characters and others."""
    edge = lambda p: rf"(?<![0-9A-Za-z_])(?:{p})(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
    found = F.lit(False)
    for pattern in CREDENTIALS:
        found = found | text.rlike(edge(pattern))
    return found


_CLOSED = {q: re.compile(rf"{q}[^{q}]*{q}", re.S) for q in "'\"`"}
_PARTS = re.compile(r"""(?P<quoted>(['"`])(?:\\.|(?!\2)[^\\])*(?:\2|\\?\Z))|(?P<mark>[;:=])""", re.S)
_SPACES = "".join(map(chr, (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def assigns_secret(line: str) -> bool:
    """Whether a line gives a name with a secret's word a quoted literal.

    Every plain ``=`` outside quotes is judged; without one, the first ``:``. The name is what stands between the last
    ``;`` before and the mark.
    """
    begin, equals, colon = 0, [], None
    for part in _PARTS.finditer(line):
        mark, at = part["mark"], part.start()
        if mark == ";":
            begin = at + 1
        elif mark == ":" and colon is None:
            colon = (begin, at)
        elif mark == "=" and line[at - 1 : at] not in tuple("=!<>") and line[at + 1 : at + 2] not in ("=", ">"):
            equals.append((begin, at))
    for start, at in equals or ([colon] if colon else []):
        value = line[at + 1 :].strip(_SPACES)
        if any(k in line[start:at].lower() for k in SECRET_KEYS) and value[:1] in _CLOSED and value[:1] and _CLOSED[value[0]].match(value):
            return True
    return False


def has_secret_line(text: str | None) -> bool:
    low = (text or "").lower()
    return any(k in low for k in SECRET_KEYS) and any(assigns_secret(line) for line in text.split("\n"))


#: A line as a row of parts: quoted literals, which may stay open to the line's end, runs of signs around ``=``, ``;``, ``:``, and the rest.
_QUOTED = "|".join(rf"{q}[^{q}\\]*+(?:\\.[^{q}\\]*+)*+(?:{q}|\\?\z)" for q in "'\"`")
_PART = rf"(?s)(?:{_QUOTED})|[=!<>]++|[;:]|[^'\"`;:=!<>]++"
_BLANK = rf"^[{_SPACES}]*\z"


def _assigns(line: Column) -> Column:
    """``assigns_secret`` as a fold over a line's parts.

    named: the statement so far holds a secret's word; value: what comes next is the value of such a name (1: by an equals sign, 2: by
    the first colon); equals, colon: one has stood; by_equals, by_colon: a value was a closed literal.
    """
    has_key = lambda part: F.lower(part).rlike("|".join(SECRET_KEYS))
    start = F.struct(*(F.lit(v).alias(k) for k, v in (("named", False), ("value", 0), ("equals", False), ("colon", False), ("by_equals", False), ("by_colon", False))))

    def step(s: Column, part: Column) -> Column:
        sign = F.substring(part, 1, 1)
        quoted, ends, colon = sign.isin("'", '"', "`"), sign == ";", sign == ":"
        mark = part.rlike("^[=!<>]")
        plain = part.rlike(r"^=(?:\z|[!<])")
        other = ~(quoted | ends | colon | mark)
        closed = quoted & (F.instr(F.substring(part, F.lit(2), F.length(part)), sign) > 0)
        named = F.when(ends, False).when(quoted | other, s["named"] | has_key(part)).otherwise(s["named"])
        value = F.when(mark, F.when((part == "=") & s["named"], 1).otherwise(0)).when(colon, F.when(~s["colon"] & s["named"], 2).otherwise(0)).when(other & part.rlike(_BLANK), s["value"]).otherwise(0)
        return F.struct(
            named.alias("named"), value.alias("value"), (s["equals"] | plain).alias("equals"), (s["colon"] | colon).alias("colon"),
            (s["by_equals"] | (closed & (s["value"] == 1))).alias("by_equals"), (s["by_colon"] | (closed & (s["value"] == 2))).alias("by_colon"))

    return F.aggregate(F.regexp_extract_all(line, F.lit(_PART), F.lit(0)), start, step, lambda s: F.when(s["equals"], s["by_equals"]).otherwise(s["by_colon"]))


def secret_assignment(text: Column) -> Column:
    """Whether a line assigns a secret. Lines without a secret's word, a sign and a quote are passed over; null texts don't."""
    may = lambda line: F.lower(line).rlike("|".join(SECRET_KEYS)) & line.rlike("[=:]") & line.rlike("['\"`]")
    lines = F.filter(F.split(F.when(F.lower(text).rlike("|".join(SECRET_KEYS)), text), "\n"), may)
    return F.coalesce(F.exists(lines, _assigns), F.lit(False))


def content_reason(content: Column, size: Column | None = None) -> Column:
    """Why a file's bytes keep it out; null if they don't."""
    size = F.octet_length(content) if size is None else size
    text = content.cast("string")
    return F.coalesce(
        F.when(size > MAX_FILE_BYTES, "too_large"),
        F.when(F.contains(content, F.lit(b"\0")), "binary"),
        F.when(~F.is_valid_utf8(text), "invalid_utf8"),
        F.when(generated_header(text), "generated"),
        F.when(pem_marker(text) | credential(text) | secret_assignment(text), "secret"))


_EDGE = re.compile("|".join(rf"(?<![0-9A-Za-z_])(?:{p})(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))" for p in CREDENTIALS))


def content_reason_of(content: bytes) -> str | None:
    """The same on the driver, for one file."""
    if len(content) > MAX_FILE_BYTES:
        return "too_large"
    if b"\0" in content:
        return "binary"
    try:
        text = content.decode()
    except UnicodeDecodeError:
        return "invalid_utf8"
    head = content[:HEADER_BYTES].lower()
    if b"code generated" in head and b"do not edit" in head:
        return "generated"
    upper = content.upper()
    if any(f"-----BEGIN {k}-----".encode() in upper for k in PEM_MARKERS) or _EDGE.search(text) or has_secret_line(text):
        return "secret"
    return None
