"""Detector patterns, taxonomy, cues and codes, as the formats and vocabularies define them.

Patterns are written for java.util.regex. White space and word boundaries are
spelled out, since Java's own differ; loops that could overflow Java's stack on
long input are unrolled and possessive.
"""

from __future__ import annotations

from dataclasses import dataclass
from string import ascii_letters, digits

SPACE = r"\t\n\x0B\f\r " + "".join(f"\\u{code}" for code in ("00A0", "1680", "2000-\\u200A", "2028", "2029", "202F", "205F", "3000", "FEFF"))
WORD = "[A-Za-z0-9_]"
EDGE = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"


@dataclass(frozen=True)
class Detector:
    """type, pattern, the cheap hints of which the text must hold one (folded: whatever the case of ASCII letters),
    the name of a check on each match, and a quick pattern that every match holds."""

    type: str
    pattern: str
    hints: tuple[str, ...] = ()
    folded: bool = True
    check: str | None = None
    needs: str | None = None


_STEM = "(?:PASSWORD|PASSWD|PWD|API[_-]?KEY|ACCESS[_-]?TOKEN|CLIENT[_-]?SECRET|SECRET(?:[_-]?ACCESS)?[_-]?KEY)"
_VALUE = r'''(?:"(?=[^"\r\n])[^"\\\r\n]*+(?:\\[^\r\n][^"\\\r\n]*+)*+"|'(?=[^'\r\n])[^'\\\r\n]*+(?:\\[^\r\n][^'\\\r\n]*+)*+'|[^''' + SPACE + r''',;"']+)'''

# The secret detectors, in the order in which they rewrite a text.
SECRETS = (
    Detector("PRIVATE_KEY", "(?iu)-----BEGIN (?:(?:RSA|EC|OPENSSH|DSA|ENCRYPTED) )?PRIVATE KEY-----|-----BEGIN PGP PRIVATE KEY BLOCK-----", ("private key",)),
    Detector(
        "API_KEY",
        EDGE + "(?:sk-[A-Za-z0-9_-]{16,}|A[KS]IA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|glpat-[A-Za-z0-9_-]{16,}|npm_[A-Za-z0-9]{20,}|hf_[A-Za-z0-9]{20,}|AIza[A-Za-z0-9_-]{30,}|(?:sk|rk)_live_[A-Za-z0-9]{16,}|xox[baprs]-[A-Za-z0-9-]{10,})" + EDGE,
        ("sk-", "AKIA", "ASIA", *(f"gh{c}_" for c in "pousr"), "github_pat_", "glpat-", "npm_", "hf_", "AIza", "_live_", "xox"), folded=False,
    ),
    Detector("ACCESS_TOKEN", f"(?iu){EDGE}(?:Bearer[{SPACE}]+[A-Za-z0-9._~+/=-]{{12,}}|Basic[{SPACE}]+[A-Za-z0-9+/]{{8,}}={{0,2}})", ("bearer", "basic")),
    Detector(
        "PASSWORD_FIELD",
        f"(?iu)(?:(?<!{WORD})(?!_)(?![A-Z0-9_]*?__)(?:[A-Z0-9_]*?(?<=_))?{_STEM}|密码)[\"']?[{SPACE}]*[:=][{SPACE}]*{_VALUE}",
        ("密码", "password", "passwd", "pwd", "api", "access", "client", "secret"), needs="[:=]",
    ),
    Detector("SESSION_CREDENTIAL", f"(?iu){EDGE}(?:Cookie|Set-Cookie)[{SPACE}]*:[{SPACE}]*[^\\r\\n]+", ("cookie",)),
    Detector("CONNECTION_CREDENTIAL", f"(?iu){EDGE}[A-Z][A-Z0-9+.-]{{1,15}}://[^/{SPACE}:@]+:[^@{SPACE}/]+@[^{SPACE}]+", ("://",)),
    Detector("CN_ID", f"{EDGE}[0-9]{{17}}[0-9Xx]{EDGE}", check="cn_id", needs="[0-9]{17}"),
    Detector("BANK_CARD", "(?<![0-9])(?:[0-9][ -]?){12,18}[0-9](?![0-9])", check="luhn", needs="[0-9](?:[ -]?[0-9]){12}"),
)
# Each character by itself: Java looks such a class up in a table. Only the beginning of a run is tried.
_RUN = "[" + ascii_letters + digits + r"+\-/=_]"
ENTROPY = Detector("HIGH_ENTROPY_CANDIDATE", r"[A-Za-z0-9+\-/=_]{32,}", check="entropy", needs=f"(?<!{_RUN}){_RUN}{{32}}")
LEAST_DISTINCT, LEAST_ENTROPY = 10, 4.2
SECRET_TYPES = (*(d.type for d in SECRETS), ENTROPY.type)

# The privacy detectors that replace what they match.
PRIVACY = (
    Detector("EMAIL", rf"(?iu){EDGE}[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}}{EDGE}", ("@",)),
    Detector("CN_MOBILE", r"(?<![0-9])(?:\+?86[- ]?)?1[3-9][0-9]{9}(?![0-9])", needs="1[3-9][0-9]{9}"),
    Detector("PHONE_NUMBER", r"(?<![0-9+])(?:\+[0-9][0-9 ().-]{5,}[0-9]|00[0-9][0-9 ().-]{5,}[0-9]|0[0-9][0-9 ().-]{5,}[0-9]|\([0-9]{2,4}\)[0-9 ().-]{4,}[0-9]|[2-9][0-9]{2}[. -][0-9]{3}[. -][0-9]{4})(?![0-9])", check="phone", needs="[0-9][0-9 ().-]{5,}[0-9]"),
)
# The privacy detectors that redact the whole line; for the `regex` module.
PY_SPACE = SPACE
LINE_PRIVACY = (
    ("LOCAL_FILE_URI", r"(?i)(?<![A-Z0-9_])file://[^\r\n\"'<>]*"),
    ("CJK_PATH_CUE", rf"(?:路径|文件|目录|位置)(?:是|为|在)?[{PY_SPACE}]*/(?:[^/{PY_SPACE}\"'<>\r\n]+(?:/[^/{PY_SPACE}\"'<>\r\n]+)+)"),
    ("POSIX_ABSOLUTE_PATH", rf"(?i)(?<![A-Z0-9._~/-])/(?:[^/{PY_SPACE}\"'<>\r\n]+(?:/[^/{PY_SPACE}\"'<>\r\n]+)*)"),
    ("WINDOWS_ABSOLUTE_PATH", r"(?i)(?:[A-Z]:[\\/]|\\\\)[^\r\n]*"),
)
ROOTS = ("Applications", "Library", "System", "Users", "Volumes", "bin", "dev", "etc", "home", "opt", "private", "root", "run", "sbin", "srv", "tmp", "usr", "var")


@dataclass(frozen=True)
class Category:
    id: str
    label: str
    keywords: tuple[str, ...]
    intent: str
    deliverable: str
    object: str
    value: str
    deprecated: bool = False


# The taxonomy; the order decides ties.
TAXONOMY_VERSION = "mvp-1"
TAXONOMY = (
    Category("software-development", "软件开发", ("代码", "开发", "调试", "测试", "bug", "api", "typescript", "javascript", "node", "python"), "build_or_debug", "code", "技术问题", "V2"),
    Category("product-planning", "产品规划", ("需求", "产品", "方案", "计划", "项目", "roadmap", "mvp", "规格", "验收"), "plan", "plan", "产品方案", "V2"),
    Category("writing", "内容写作", ("写作", "文案", "文章", "邮件", "总结", "润色", "翻译", "email", "draft"), "create_content", "document", "内容稿件", "V1"),
    Category("learning-research", "学习研究", ("学习", "研究", "论文", "课程", "解释", "分析", "调研", "research", "learn"), "learn_or_research", "notes", "研究主题", "V2"),
    Category("personal-life", "个人生活", ("旅行", "饮食", "健身", "生活", "家庭", "购物", "菜谱", "travel", "recipe"), "personal_assistance", "advice", "生活事项", "V1"),
    Category("other", "其他主题", (), "unknown", "unknown", "待确认事项", "V0"),
)

# Lifecycle cues and labels.
NEGATION = rf"(?iu){EDGE}(?:unresolved|unfinished|incomplete|not[{SPACE}]+(?:(?:yet|fully)[{SPACE}]+)?(?:resolved|finished|done|completed)|never[{SPACE}]+(?:resolved|finished|done|completed)){EDGE}|(?:未|没|尚未|没有)(?:全部|完全)?(?:完成|解决)"
CUES = (
    ("completed", rf"(?iu)已完成|完成了|已解决|{EDGE}(?:resolved|finished|done|completed){EDGE}"),
    ("pending", rf"(?iu)等待|待办|稍后|{EDGE}(?:pending|todo){EDGE}"),
    ("archived", rf"(?iu)归档|不再处理|{EDGE}archived{EDGE}"),
)
#: Words of which a text with the cue holds one, unless it has letters outside of ASCII that (?iu) takes for s, k or i.
CUE_WORDS = {"completed": ("已完成", "完成了", "已解决", "resolved", "finished", "done", "completed"), "pending": ("等待", "待办", "稍后", "pending", "todo"), "archived": ("归档", "不再处理", "archived")}
FOLDED_TO_ASCII = r"[\u017F\u212A\u0130\u0131]"
STATUS_LABELS = {"active": "进行中", "pending": "待处理", "completed": "已完成", "archived": "已归档"}

# The confidence policy.
NO_KEYWORD, TIED, ONE_KEYWORD, MORE_KEYWORDS = 0.3, 0.5, 0.68, 0.84
ACTIVE, EXPLICIT, REVIEW_BELOW = 0.55, 0.8, 0.8

# Codes and names of the contract.
RISK_FLAGS = ("SENSITIVE_PATTERN", "S3_CANDIDATE")
REASONS = ("LOW_CONFIDENCE", "MULTI_TOPIC", "SENSITIVE_PATTERN", "S3_CANDIDATE", "UNKNOWN_PROJECT", "BRANCH_FALLBACK", "EMPTY_CONTENT", "CONTENT_TRUNCATED")
VALUES, LEVELS = ("V0", "V1", "V2", "V3"), ("S0", "S1", "S2", "S3")
CONFIDENCES = ("primaryCategoryId", "lifecycleStatus", "suggestedTitle")
PROVIDER = "heuristic-provider"
SCHEMA_VERSION = "1.4"
UNTITLED = "未命名对话"
ATTACHMENT_KEYS = ("filename", "file_name", "fileName", "name", "content_type", "contentType", "mime_type", "mimeType")

# Limits.
MAX_INPUT_BYTES, MAX_ITEM_BYTES, MAX_TOKENS, MAX_DEPTH = 256 << 20, 8 << 20, 250_000, 64
MAX_NODES, MAX_ITEMS, MAX_CHARACTERS = 50_000, 50_000, 32 * 1024
PREVIEW_ITEMS, PREVIEW_FAILURES = 20, 10

# What item failures say.
FAILURES = {
    "INVALID_CONVERSATION": "对话项不是受支持的对象。",
    "MISSING_CONVERSATION_ID": "对话项缺少稳定 ID。",
    "MISSING_MAPPING": "对话项缺少 mapping 对象。",
    "MAPPING_NODE_LIMIT_EXCEEDED": "对话 mapping 节点数量超过安全上限。",
    "INVALID_BRANCH": "对话分支结构无效。",
    "CLASSIFICATION_INVALID": "分类结果未通过运行时校验。",
    "OUTPUT_SANITIZATION_FAILED": "该项输出未通过隐私校验。",
    "INVALID_ITEM_JSON": "对话项 JSON 无法解析。",
    "ITEM_PROCESSING_FAILED": "对话项处理失败。",
}
