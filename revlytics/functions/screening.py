"""What a merged change is, by its title, its body and its lines: screens, defect classes, difficulty, provenance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of titles and bodies.
FIX_KEYWORDS = r"(?i)\b(fix|fixes|fixed|bug|bugfix|regression|security|vulnerab\w*|cve-\d{4}-\d+|ghsa-[\w-]+|exploit|leak|race condition|off[- ]by[- ]one|crash|incorrect|broken)\b"
CVE_PATTERN = r"(?i)\b(cve-\d{4}-\d{4,7}|ghsa-[a-z0-9]{4}-[a-z0-9]{4}-[a-z0-9]{4})\b"
LINKED_ISSUE = r"(?i)(fix(?:es|ed)?|close[sd]?|resolve[sd]?)\s+#\d+"
EXCLUDE_KEYWORDS = r"(?i)\b(revert|reverts|reverting|refactor\w*|rename\w*|clean up|typo|format\w*|lint\w*|black|isort|flake8|bump|downgrade|dependabot|pre-commit|changelog|documentation|whitespace|deprecat\w*|test only|add tests?|more tests?)\b"
RELEASE_TITLE = r"(?i)^\s*(v(ersion)?\s*)?\d+\.\d+(\.\d+)?([-.\w]*)?\s*$"
DEPENDENCY_UPGRADE = r"(?i)\b(upgrade|upgrading)\b.{0,30}?(\bto\b\s*v?\d|\bv?\d+\.\d+|\bdeps?\b|\bdependenc\w+|\brequirements?\b)"
SUBJECT_ONLY_PREFIX = r"(?i)^\s*(docs?|cleanup|comments?|style|styles)\b\s*[:(\[/-]"
BACKPORT_PATTERN = r"(?i)\bbackport\b|^\s*\[\s*\d+\.\d+[\w.]*\s*\]"
TEST_PATH = r"(^|/)(tests?|testing)/|(^|/)test_[^/]*\.py$|_test\.py$"
VERSION_ASSIGNMENT = r"(?i)^\s*(__version__|__build__|VERSION|version|release|__release__)\s*(:\s*\w+\s*)?="
# Defect classes in the order in which they are tried: name, weakness, severity, whether line rules cover it, patterns of its code.
DEFECT_CLASSES = (
    ("crypto-weak", "CWE-328", "high", True, (
        r"(?i)\b(md5|sha1)\s*\(", r"(?i)hashlib\.(md5|sha1)\b", r"(?i)\brandom\.(random|randint|choice|shuffle)\b", r"(?i)\b(DES|RC4|ECB)\b",
        r"(?i)verify\s*=\s*False|check_hostname\s*=\s*False", r"(?i)ssl\._create_unverified_context|CERT_NONE", r"(?i)AutoAddPolicy|WarningPolicy",
    )),
    ("injection", "CWE-78", "critical", True, (
        r"\b(eval|exec)\s*\(", r"\bshell\s*=\s*True\b", r"(?i)os\.(system|popen)\s*\(", r"(?i)(execute|executemany|raw|query)\s*\(\s*(f['\"]|['\"].*(\+|%))",
        r"(?i)yaml\.load\s*\((?![^)]*Loader)", r"(?i)pickle\.loads?\s*\(", r"(?i)autoescape\s*=\s*False",
    )),
    ("secret-exposure", "CWE-798", "high", True, (
        r"(?i)\b(password|passwd|api[_-]?key|secret|token|credential)s?\b\s*=\s*['\"][^'\"]{4,}['\"]", r"(?i)(log\w*|print)\s*\([^)]*\b(password|token|secret|api[_-]?key|authorization)\b",
    )),
    ("path-traversal", "CWE-22", "high", True, (
        r"(?i)os\.path\.join\s*\([^)]*\b(request|user|input|param|name|arg)", r"(?i)(extractall|extract)\s*\(", r"(?i)\.\./", r"(?i)open\s*\(\s*(f['\"]|[^,)]*\+)",
    )),
    ("concurrency", "CWE-362", "high", False, (
        r"(?i)\b(threading|asyncio)\.(Lock|Event|Semaphore|Condition)\b", r"(?i)\b(acquire|release)\s*\(\s*\)", r"(?i)os\.path\.exists\s*\([^)]*\)\s*(and|:)",
        r"(?i)\b(create_task|ensure_future|run_until_complete|gather)\b", r"(?i)\basync\s+def\b|\bawait\b", r"(?i)\b(global|nonlocal)\b",
    )),
    ("resource-leak", "CWE-772", "medium", False, (
        r"(?i)\b(open|connect|socket|Session|ClientSession)\s*\(", r"(?i)timeout\s*=\s*(None|0)\b", r"(?i)\b(close|shutdown|__exit__|finally)\b", r"(?i)tempfile\.mktemp\s*\(",
    )),
    ("auth-bypass", "CWE-285", "critical", False, (
        r"(?i)\b(is_authenticated|has_perm|has_permission|require\w*|check_perm\w*|is_superuser|is_staff|authorize\w*)\b", r"(?i)\bassert\b.*\b(auth|perm|user|admin|token)\b", r"(?i)@(login_required|permission_required|csrf_exempt)",
    )),
    ("logic-boundary", "CWE-193", "medium", False, (r"(<=|>=|<|>|!=|==)", r"(?i)\b(len|range|index|slice|offset|count|size|limit)\b", r"[+-]\s*1\b", r"(?i)\b(and|or|not)\b")),
    ("input-validation", "CWE-1284", "medium", False, ()),
    ("type-contract", "CWE-704", "medium", False, ()),
    ("encoding", "CWE-116", "medium", False, ()),
    ("protocol-state", "CWE-372", "medium", False, ()),
)
# The class of what no other fits, the classes whose difficulty is in their running, and code that can be found by its letters.
DEFAULT_CLASS = "logic-boundary"
RUNTIME_CLASSES = ("concurrency", "resource-leak")
LITERAL_CODE = r"(?i)(\b(eval|exec)\s*\(|shell\s*=\s*True|hashlib\.(md5|sha1)|yaml\.load\s*\((?![^)]*Loader)|pickle\.loads?\s*\(|verify\s*=\s*False|os\.(system|popen)\s*\(|tempfile\.mktemp|\b(password|api[_-]?key|secret|token)\b\s*=\s*['\"][^'\"]{4,}['\"])"
DEF_LINE = r"^[+\- ]?\s*(?:async\s+)?def\s+(\w+)"


def found(text: Column, pattern: str) -> Column:
    """Whether a text holds a pattern, with Unicode's letters; null holds nothing."""
    return F.coalesce(text, F.lit("")).rlike(f"(?U){pattern}")


def _subject(title: Column) -> Column:
    """Why a title isn't that of an ordinary change; null if it may be."""
    return (
        F.when(found(title, BACKPORT_PATTERN), "backport-duplicate").when(found(title, EXCLUDE_KEYWORDS), "excluded-keyword").when(found(title, RELEASE_TITLE), "release-commit")
        .when(found(title, DEPENDENCY_UPGRADE) | found(title, SUBJECT_ONLY_PREFIX), "excluded-keyword")
    )


def _both(title: Column, body: Column) -> Column:
    return F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(body, F.lit("")))


def screen_fix(title: Column, body: Column) -> Column:
    """Why a change isn't taken for a fix, by title and body alone; null if it is."""
    return F.coalesce(_subject(title), F.when(~found(_both(title, body), FIX_KEYWORDS), "not-a-bugfix"))


def screen_clean(title: Column, body: Column) -> Column:
    """Why a change isn't taken for an ordinary one; null if it is."""
    return F.coalesce(_subject(title), F.when(found(_both(title, body), FIX_KEYWORDS), "looks-like-a-bugfix"))


def is_test_path(path: Column) -> Column:
    return found(F.replace(path, F.lit("\\"), F.lit("/")), TEST_PATH)


def label_provenance(title: Column, body: Column) -> Column:
    both = _both(title, body)
    return F.when(found(both, CVE_PATTERN), "cve").when(found(both, LINKED_ISSUE), "linked-issue").otherwise("title-keyword")


def defect_class(code: Column, title: Column) -> Column:
    """name, cwe, severity, rule_covered, basis of the faulty code: the first class with a pattern that it holds, else the first whose name the title begins to say, else the default."""

    def made(item: tuple, basis: str) -> Column:
        name, cwe, severity, covered, _ = item
        return F.struct(F.lit(name).alias("name"), F.lit(cwe).alias("cwe"), F.lit(severity).alias("severity"), F.lit(covered).alias("rule_covered"), F.lit(basis).alias("basis"))

    by_code, by_title = F, F
    for item in DEFECT_CLASSES:
        if item[4]:
            test = found(code, item[4][0])
            for p in item[4][1:]:
                test = test | found(code, p)
            by_code = by_code.when(test, made(item, "code-pattern"))
        by_title = by_title.when(F.contains(F.lower(F.coalesce(title, F.lit(""))), F.lit(item[0].split("-")[0])), made(item, "title-word"))
    default = next(made(item, "fallback-default") for item in DEFECT_CLASSES if item[0] == DEFAULT_CLASS)
    return F.coalesce(by_code, by_title, default)


def difficulty(seeds: Column, n_files: Column, n_functions: Column, name: Column) -> Column:
    """L4 for classes of running code, L3 for several files or functions, L1 for one line that letters find, else L2."""
    literal = (F.size(seeds) == 1) & found(F.get(seeds, 0), LITERAL_CODE)
    return F.when(name.isin(*RUNTIME_CLASSES), "L4").when((n_files >= 2) | (n_functions >= 2), "L3").when(literal, "L1").otherwise("L2")
