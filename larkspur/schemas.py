"""Schemas of the stores, as DDL."""

MEMORIES = "row_id long, text string, importance double, source string, behaviour_score double, deprecated boolean, suppressed boolean, suppress_reason string, suppressed_at timestamp, created_at timestamp, embedding array<float>"
FILES = "path string, sha256 string, language string, weight double, indexed_at timestamp"
SYMBOL = "name string, type string, start_line int, end_line int, docstring string, calls array<string>, decorators array<string>, tags array<string>, bases array<string>"
SYMBOLS = f"file string, {SYMBOL}"
SYMBOL_VECTORS = "row_id long, name string, type string, file string, start_line int, docstring string, source string, weight double, embedding array<float>"
POSTINGS = "word string, file string, line int"
NODES = "id string, type string, file string, line int, weight double, seq long"
EDGES = "src string, dst string, rel string, weight double, purpose string, seq long"
EPISODES = "id string, event string, metadata map<string,string>, time timestamp, prev string, stale boolean, stale_reason string"
LEARNINGS = "id string, type string, scope string, text string, timestamp timestamp, deprecated boolean, supersedes string, metadata map<string,string>"
SYMBOL_WEIGHTS = "symbol string, hit_count double, relevance double, last_hit timestamp"
QUERY_HISTORY = "query_id string, text string, time timestamp, symbols array<string>, useful boolean, file_edited string"
COOCCURRENCE = "file_a string, file_b string, n long"
ERRORS = "error_type string, message string, file string, time timestamp"
CLEANUP = "entry_id string, store string, importance double, suppressed_at timestamp, similarity double"
REPOS = "org string, project string, path string, name string, parent string"
ORG_EDGES = "src string, dst string, kind string, auto boolean, note string"
SESSIONS = "session_id string, created_at timestamp, closed_at timestamp, model string, messages array<struct<role:string,content:string>>"
CHUNKS = "source string, section string, position int, text string"
COMMITS = "hash string, author string, date timestamp, message string, added long, removed long, hunks long"
COMMIT_FILES = "hash string, time timestamp, path string"
METRICS = "run_at timestamp, metric string, value double"
GOLDEN = "query string, expected_symbol string, expected_file_pattern string"
