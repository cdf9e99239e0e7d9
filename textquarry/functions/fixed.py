"""Fixed values that results depend on."""

# Vocabularies and weights of the ranking.
ROOT_MARKERS = ("src", "lib", "app", "packages", "internal", "cmd", "pkg", "core", "api")
ANCHOR_STEMS = (
    "index", "main", "mod", "__init__", "app", "server", "cli", "setup", "lib", "entry", "bootstrap", "config", "schema",
    "types", "models", "router", "routes", "client", "api", "core",
)
ANCHOR_ENDINGS = ("server", "cli", "api", "main", "index")
STRUCTURAL_ENDINGS = ("types", "schema", "model", "models", "config", "constants")
SOURCE_EXTS = (
    ".py", ".pyi", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".go", ".rs", ".java", ".kt", ".kts", ".rb", ".php", ".c",
    ".h", ".cc", ".cpp", ".cxx", ".hpp", ".cs", ".swift", ".scala", ".sql", ".graphql", ".gql", ".proto", ".vue", ".svelte",
    ".ex", ".exs", ".erl", ".hs", ".ml", ".clj", ".zig", ".lua", ".dart", ".sh", ".bash", ".zsh",
)
DOC_EXTS = (".md", ".mdx", ".rst", ".txt", ".adoc")
CONFIG_EXTS = (".json", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".env")
NOISE_STEMS = (
    "changelog", "changes", "history", "license", "licence", "copying", "contributing", "code_of_conduct", "authors", "notice",
    "security", "funding", "governance", "maintainers",
)
LOW_VALUE_DIRS = (
    "test", "tests", "spec", "specs", "__tests__", "e2e", "fixtures", "testdata", "migrations", "examples", "example",
    "scripts", "tools", "docs", "doc", "assets", "static", "public", "vendor", "third_party",
)
VENDOR_DIRS = ("vendor", "third_party", "node_modules", "extern", "deps")
GENERATED_MARKERS = (".min.", ".generated.", ".g.", "_pb2", ".pb.", ".d.ts")

# The token cost model, class -> (characters a token, free characters of a piece).
TOKEN_COSTS = {
    "letters": (3.615, 4.0),
    "digits": (3.0, 3.0),
    "punct": (1.215, 2.0),
    "ws": (4.626, 3.005),
    "mixed": (3.5, 0.0),
    "underscore": (3.0, 0.0),
    "nonascii": (1.727, 0.0),
}
SIZE_CHARS_PER_TOKEN = 3.4

# What is skipped without any ignore file.
HARD_SKIP_DIRS = (".git", ".hg", ".svn", "__pycache__", "node_modules", ".venv", ".tox")
DEFAULT_IGNORES = (
    ".git/", ".hg/", ".svn/", ".idea/", ".DS_Store", "Thumbs.db", "node_modules/", "bower_components/", "vendor/", ".venv/",
    "venv/", "env/", ".bundle/", "dist/", "build/", "out/", "target/", ".next/", ".nuxt/", ".svelte-kit/", ".turbo/",
    ".parcel-cache/", "*.egg-info/", "__pycache__/", ".mypy_cache/", ".pytest_cache/", ".ruff_cache/", ".cache/", "htmlcov/",
    ".coverage", "coverage/", "*.min.js", "*.min.css", "*.min.mjs", "*.map", "*.pb.go", "*_pb2.py", "*_pb2_grpc.py",
    "*.generated.*", "*.lock", "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "Cargo.lock", "poetry.lock",
    "composer.lock", "Gemfile.lock", "*.snap", "__snapshots__/", "testdata/", "fixtures/", "*.png", "*.jpg", "*.jpeg", "*.gif",
    "*.webp", "*.ico", "*.pdf", "*.zip", "*.gz", "*.tar", "*.7z", "*.wasm", "*.mp4", "*.mov", "*.mp3", "*.wav", "*.woff",
    "*.woff2", "*.ttf", "*.otf", "*.eot", "*.bin", "*.db", "*.sqlite", "*.so", "*.dylib", "*.dll", "*.exe",
)
SNIFF_BYTES = 8192

# The import graph.
JS_EXTS = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs")
RUNTIME_SOURCES = {".js": (".ts", ".tsx", ".d.ts"), ".jsx": (".tsx",), ".mjs": (".mts", ".d.mts"), ".cjs": (".cts", ".d.cts")}
ENTRY_STEMS = ("main", "index", "__init__", "app", "server", "cli", "entry", "bootstrap")
FAN_OUT = 8
HOP_DECAY = 0.6
