"""Fixed values that results depend on."""

#: File suffix to language.
LANGUAGES = {".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".go": "go", ".rs": "rust", ".java": "java", ".rb": "ruby"}
#: Folders that scanning leaves out, and those that the path rules leave out besides.
SCAN_SKIP_DIRS = [".git", "node_modules", ".venv", "venv", "dist", "build", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", "tests", "test"]
EXCLUDED_DIRS = [*SCAN_SKIP_DIRS, ".next", "target", "vendor", ".idea", ".vscode"]
EXCLUDED_SUFFIXES = [".lock", ".min.js", ".min.css", ".map", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".webp", ".pdf", ".zip", ".tar", ".gz", ".woff", ".woff2", ".ttf", ".mp3", ".mp4", ".mov", ".wav"]
EXCLUDED_NAMES = ["package-lock.json", "yarn.lock", "poetry.lock", "Cargo.lock", "uv.lock", "Gemfile.lock", "composer.lock", "pnpm-lock.yaml"]
#: Patterns of credentials, searched case-sensitively.
SECRETS = [
    r"AKIA[0-9A-Z]{16}",
    r"ghp_[A-Za-z0-9]{36}",
    r"gho_[A-Za-z0-9]{36}",
    r"github_pat_[A-Za-z0-9_]{82}",
    r"sk-[A-Za-z0-9]{32,}",
    r"xox[baprs]-[A-Za-z0-9-]{10,}",
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    r"AIza[0-9A-Za-z_\-]{35}",
]
MAX_BYTES, MAX_LINES, HEAD_BYTES = 102_400, 5_000, 1024
SECRETS_LOG = "secrets_warn.log"
#: Parts of a word in camel case.
CAMEL = r"([A-Z][a-z]+|[A-Z]+(?=[A-Z]|$))"
CHUNK_LINES, CHUNK_OVERLAP, CHUNK_CHARS = 40, 5, 2000
TOP_K, RRF_K, FUSED, FINAL, MAX_PER_FILE = 20, 60, 20, 5, 2
CONTEXT_LINES, CONTEXT_MAX = 30, 300
RANGE_MAX_LINES, RANGE_MAX_BYTES = 300, 10 << 20
BFS_MAX_DEPTH, BFS_MAX_RESULTS, REFS_LIMIT, GREP_LIMIT = 3, 50, 50, 30
#: What a snapshot never holds, as ignore rules.
SNAPSHOT_SKIPS = [".git/", "node_modules/", ".venv/", "venv/", "__pycache__/", "dist/", "build/", "*.pyc", ".DS_Store", ".env", ".env.*", "*.log"]
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
TRUST = "untrusted_repository_content"
#: Letters with marks and without, for folding.
MARKED, PLAIN = "àâäáçéèêëíïîñóöôúüùû", "aaaaceeeeiiinooouuuu"
EMBEDDING_DIM, EMBEDDING_BATCH = 384, 32
SCRUB_LENGTH = 500
#: What a symbol's name looks like, characters that a file's name may not have, and the day in the name of a log.
SYMBOL, UNSAFE, LOG_DAY = r"[A-Za-z_][A-Za-z0-9_.]*", r"[^A-Za-z0-9._-]", r"queries-(\d{4}-\d{2}-\d{2})\.jsonl$"
#: How a file's role is told from its path, in this order: names, name starts, name ends, folders and suffixes.
TEST_DIRS = ["tests", "test", "__tests__", "spec"]
TEST_ENDS = ["_test.py", ".test.ts", ".test.tsx", ".test.js", ".test.jsx", ".spec.ts", ".spec.tsx", ".spec.js", ".spec.jsx"]
BUILD_NAMES = ["pyproject.toml", "uv.lock", "poetry.lock", "package.json", "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "cargo.toml", "cargo.lock", "go.mod", "go.sum", "makefile", "dockerfile"]
DOC_SUFFIXES = [".md", ".rst", ".txt"]
SCRIPT_SUFFIXES = [".sh", ".bash", ".zsh"]
CONFIG_SUFFIXES = [".yaml", ".yml", ".toml", ".json", ".ini", ".cfg", ".conf"]
SOURCE_LANGUAGES = ["python", "typescript", "tsx", "javascript", "jsx", "go", "rust", "ruby", "java", "kotlin", "swift", "c", "cpp", "c_sharp", "php", "scala", "bash", "sql"]
SOURCE_SUFFIXES = [".py", ".ts", ".tsx", ".js", ".jsx", ".go", ".rs", ".rb", ".java", ".kt", ".swift", ".c", ".cpp", ".h", ".hpp", ".cs", ".php", ".scala", ".sql"]
