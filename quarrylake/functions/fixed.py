"""Words, patterns, tables and limits that results depend on, stated as they are used elsewhere.

Nothing here computes.  Patterns are for Python's ``re`` with ASCII word classes unless said otherwise.
"""

# fmt: off
# Wording that is meant to keep applying.
DURABLE = (
    r"앞으로", r"이제부터", r"지금부터", r"다음부터", r"다음에도", r"항상", r"언제나", r"매번", r"절대", r"반드시", r"무조건", r"꼭\s", r"명심", r"잊지\s*마", r"규칙", r"원칙",
    r"정책", r"컨벤션", r"금지", r"통일", r"프로젝트\s*전체", r"모든\s*(파일|곳|코드|api|테스트|화면|모듈|함수|클래스)",
    r"(하|쓰|사용하|만들|넣|두|붙이|바꾸|건드리|올리|지우|추가하|남기|쓰이)지\s*(마|말|않)",
    r"\bfrom now on\b", r"\bgoing forward\b", r"\balways\b", r"\bnever\b", r"\bdon'?t ever\b", r"\bdo not ever\b", r"\bin (the )?future\b", r"\bas a rule\b", r"\bconvention\b",
    r"\bpolicy\b", r"\bevery time\b", r"\bacross the (project|codebase|repo)\b",
)
# Wording that corrects what was just done.
CORRECTION = (
    r"^\s*(아니|아냐|아뇨|노노|ㄴㄴ)", r"그게\s*아니", r"(그거|이거|저거)\s*말고", r"\S\s*말고\s+\S", r"대신에?\s", r"잘못", r"틀렸|틀린", r"왜\s*.{0,20}(했|한|썼|쓴|넣었|만들었|바꿨)",
    r"다시\s*(해|하|작성|만들|고쳐|짜)", r"되돌려|원래대로|롤백", r"(라고|하라고|말라고)\s*(했|말했)", r"했잖아|말했잖아|하랬잖아",
    r"^\s*no\b[,.! ]", r"\bthat'?s (wrong|not right|not what)\b", r"\bnot what i (asked|wanted|meant)\b", r"\binstead\b", r"\brevert\b", r"\bundo\b", r"\bi (said|told you)\b",
    r"\bstop (doing|using|adding|creating)\b", r"\bwhy did you\b", r"\bdon'?t (use|add|do|create|write|put|change)\b",
)
# Wording limited to the task at hand.
ONE_OFF = (
    r"이번만", r"이번에?는", r"이번\s*한\s*번", r"일단(?!위)", r"임시로", r"잠깐", r"테스트로", r"\bjust this once\b", r"\bfor now\b", r"\btemporar(y|ily)\b", r"\bthis time\b",
    r"\bfor this (task|pr|change|commit)\b",
)
# The part of the above that leaves a single sentence out.
TASK_ONLY = (r"이번만", r"이번에?는", r"이번\s*한\s*번", r"일단(?!위)", r"임시로", r"\bjust this once\b", r"\bfor now\b", r"\bthis time\b", r"\bfor this (task|pr|change|commit)\b")
# Requests to remember.
REMEMBER = (r"기억해", r"기억\s*해\s*줘", r"\bremember\b", r"\bkeep in mind\b")
# Signs of a question and of a proposal at the end of a reply.
KO_QUESTION_END = r"(까|니|냐|나|나요|가요|래|래요|는지|은지|던가|건가|걸까|어때|어떄|뭐야|뭐지|왜|맞지|되나|될까|있나|없나)$"
EN_QUESTION_START = r"^(what|why|how|where|when|which|who|whose)\b"
PROPOSAL = (r"[?？]\s*$", r"(할까요|드릴까요|하시겠어요|하시겠습니까|어떨까요|좋을까요|괜찮을까요|원하시나요|진행할까요)", r"\b(should I|shall I|do you want|would you like|want me to)\b")
PROPOSAL_TAIL = 400
# Bare acknowledgements.
ACK = (
    r"^(ok(ay)?|k|y(es)?|no?|네|넵|예|응|ㅇㅇ|ㅇㅋ|오케이|좋아(요)?|고마워(요)?|감사(합니다)?|thanks?|thank you|thx|ty|lgtm|done|go( on)?|continue|계속(해)?|진행(해)?|해줘|그래|맞아)"
    r"[\s.!~?]*$"
)
# Cues that a prompt goes on with earlier work.
CONTINUE_CUE = (
    r"(이어서|이어 ?가|마저|아까|지난번|저번에?|전에 하던|하던 (거|것|작업|일)|어디까지|계속 ?(해|하자|진행|작업)|^\s*계속\s*[.!~]*\s*$|\bcontinue\b|\bresume\b|pick (it )?up|carry on|"
    r"keep going|where (were we|did we (leave|stop))|last (session|time)|previous session|left off)"
)
# Kinds of lines in pasted text.
CODE_END = r"(;|\{|\(|\*\/)\s*$"
CODE_START = r"^\s*([}\])]|at [\w$.<>]+\(.*\)\s*$)"
CODE_COMMENT = r"^\s*(--\s|\/\/|\/\*|\*\/|#!)"
LITERALS = r"'[^']*'|\"[^\"]*\"|`[^`]*`"
LINE_COMMENT = r"(--|\/\/|#).*$"
REVIEW_MARKER = (
    r"^\s*[•◦▪▸►‣●○■□◆◇]\s*(현상|문제|문제점|원인|영향|권장|권장\s*사항|제안|수정\s*제안|해결|해결\s*방안|개선|개선\s*방안|이슈|위험|근거|재현|조치|대안|problem|issue|impact|cause|root cause|"
    r"suggestion|recommendation|proposed fix|fix|risk|severity|evidence)\s*[:：]",
    r"\(\s*\d+(\.\d+)+절", r"\d+\s*[–—-]\s*\d+\s*행(에서|에|의|을|를|은|는|까지)", r"\bL\d+\s*[-–]\s*L?\d+\b", r"\blines?\s+\d+\s*[-–]\s*\d+\b",
)
POINTS_ABOVE = (
    r"^\s*(이런|이러한|이와\s*같은|위|위의|위에)\s*(코드\s*)?(리뷰|코멘트|피드백|지적)\s*(가|이|를|을|는|은|도|좀)?\s*(있|왔|달렸|받았|봐|보고|확인|반영|참고)",
    r"^\s*(the |this )?(code )?(review|comments?|feedback) above\b",
)
FENCED = r"(```|~~~)[\s\S]*?(\1|$)"
LONG_LINE = 400
# Labels under which a reply says what is left.
PENDING_LABEL = (
    r"(남은\s*(?:작업|일|것|항목|과제)|다음\s*(?:단계|작업|할\s*일|에\s*할\s*일)|후속\s*(?:작업|조치)|해야\s*할\s*일|할\s*일|미완료|미해결|추가로\s*필요한\s*(?:것|작업)|TODO|To[- ]?do|Next\s+steps?|"
    r"Remaining(?:\s+(?:work|items|tasks))?|Follow[- ]?ups?|Not\s+(?:yet\s+)?done|Open\s+(?:items|questions|issues)|Left\s+to\s+do|What'?s\s+left|Known\s+issues)"
)
PENDING_LIMIT = 800
# Korean particles, predicate endings and words that name no topic.
KO_PARTICLE = r"(으로부터|에서부터|으로서|으로써|에게서|에서|에게|한테|으로|까지|부터|처럼|보다|마다|이나|이랑|은|는|이|가|을|를|의|에|로|와|과|도|만|랑)$"
KO_PREDICATE = r"(다|고|며|게|요|죠|야|어|아|해|돼|라|자|지|는|은|한|할|된|될|던|든|서|면)$"
KO_VERB_ROOT = r"(하|되|있|없|않|같)$"
KO_OPEN_ENDING = r"[서고야게지]$"
KO_STOPWORDS = (
    "앞으로 이제부터 지금부터 다음부터 다음에도 항상 언제나 매번 절대 반드시 무조건 경우 때문 그리고 하지만 그래서 또는 그냥 이번 우리 다시 먼저 바로 같이 계속 모두 전부 그대로 아직 이미 정말 너무"
).split()
# Words of rules that name nothing in particular.
GENERIC_TERMS = (
    "api apis ui ux ci cd pr prs id ids url urls uri http https json yaml yml xml csv sql db dto orm sdk cli ide test tests code file files log logs error errors bug fix class type types function "
    "method module package repo git commit branch main master merge dev prod build run script config env ok true false null none utf utc"
).split()
# How a rule names what is to be left.
NEGATIVE_NAME = (
    r"([A-Za-z][\w.+#@/-]*)\s*(?:을|를|은|는|이|가|로|으로|와|과)?\s*(?:대신|말고|빼고|금지|쓰지|사용하지|사용 금지|쓰면 안|제외)",
    r"([A-Za-z][\w.+#@/-]*)\s*에서\s*[A-Za-z][\w.+#@/-]*\s*(?:으로|로)",
    r"(?i)\b(?:instead of|rather than|not|never|no|avoid|without|stop using|don't use|do not use|drop|remove|replace|from)\s+(?:the\s+|using\s+|use\s+)?([A-Za-z][\w.+#@/-]*)",
)
# Shell commands that check work.
CHECK_RUNNER = (
    r"^(?:\w+=\S*\s+)*(?:(?:npm|pnpm|yarn|bun)\s+(?:run\s+)?(?:-s\s+|--silent\s+)?[\w:.-]*(?:test|build|lint|check|typecheck|tsc|bench|verify|ci)[\w:.-]*|(?:npx|bunx|pnpm\s+exec|pnpm\s+dlx|yarn)\s+"
    r"(?:tsc|jest|vitest|eslint|mocha|playwright|biome|prettier\s+--check)\b|node\s+--test|deno\s+(?:test|check|lint)|(?:python3?\s+-m\s+|uv\s+run\s+|poetry\s+run\s+)?(?:pytest|unittest|tox|nox|mypy|ruff|"
    r"pyright|flake8)\b|go\s+(?:test|vet|build)\b|cargo\s+(?:test|build|check|clippy|nextest)\b|\.?\/?gradlew?\s+[\w:-]*(?:test|build|check|assemble)|mvnw?\s+[\w:-]*(?:test|verify|package|compile)|"
    r"make\s+[\w-]*(?:test|check|build|lint|ci)\b|ctest\b|tsc\b|eslint\b|rspec\b|bundle\s+exec\s+(?:rspec|rake)|(?:vendor\/bin\/)?phpunit\b|dotnet\s+(?:test|build)\b|swift\s+(?:test|build)\b|xcodebuild\b|"
    r"mix\s+test\b|flutter\s+test\b|dart\s+test\b)"
)
# Exit codes in output, marks of failed and of passed runs, lines that tell of an error.
EXIT_CODES = (r"Process exited with code (-?\d+)", r"(?:completed|exited) with exit code (-?\d+)", r"\"exit_code\"\s*:\s*(-?\d+)", r"(?m)^Exit code:? (-?\d+)")
SCRIPT_FAILED = r"(?m)^Script failed"
FAIL_MARK = (
    r"(?m)(\b[1-9]\d*\s+(?:tests?\s+|specs?\s+)?fail(?:ed|ing|ures?)\b|\bFAILED\b|\bBUILD FAILED\b|^\s*FAIL\s|\berror TS\d+|\bnpm (?:ERR!|error)\b|Traceback \(most recent call last\)|\bpanicked at\b|"
    r"^\s*error(?:\[E\d+\])?:|^e: )"
)
PASS_MARK = r"(?im)(\bBUILD SUCCESSFUL\b|\b\d+\s+(?:tests?\s+)?passed\b|\btests? passed\b|^ok\s+\S+|\bAll tests passed\b|Found 0 errors|\b0 (?:errors|failures|failed)\b)"
ERROR_LINE = r"(?i)(error|fail|exception|cannot|could not|not found|missing|expected|assert|traceback|panicked|denied|refused|TS\d{4}|ERR_)"
NOISE_LINE = r"^(Wall time|Chunk ID|Original token count|<shellId)"
# Identifiers of an error, the most telling first, and those that tell nothing.
SIGNATURES = (
    r"\b(TS\d{4,5})\b", r'(Missing script: "[^"\n]{1,60}")', r"(No module named '[^'\n]{1,80}')", r"(Cannot find module '[^'\n]{1,80}')", r"error\[(E\d{4})\]", r"\b(ERR_[A-Z0-9_]{3,})\b",
    r"Execution failed for task '([^'\n]{2,100})'", r"> Task (:\S{2,100}) FAILED", r"\bnpm (?:ERR!|error) code (E[A-Z]{3,})\b",
)
EXCEPTION_NAME = r"\b([A-Z][A-Za-z0-9]{2,}(?:Exception|Error))\b"
GENERIC_EXCEPTIONS = (
    "Error TypeError ReferenceError SyntaxError RangeError AssertionError AssertionFailedError Exception RuntimeException IllegalStateException IllegalArgumentException ValueError KeyError StandardError"
).split()
RUNNER_CODES = r"^(ERR_ASSERTION|ERR_TEST_FAILURE|ERR_PNPM_RECURSIVE\w*|ERR_PNPM_\w*_FAIL\w*|ERR_UNHANDLED_REJECTION|ELIFECYCLE|ENOENT|EACCES|EPERM|EEXIST)$"
GENERIC_TASK = r"(?i)^:(.*:)?(test\w*|check|build|assemble|lint\w*|compile\w*|jar|bootJar|classes)$"
# Endings of source files, and names that look like files but are none.
SOURCE_EXT = (
    r"\.(kt|kts|java|scala|groovy|go|py|rb|rs|ts|tsx|js|jsx|mjs|cjs|vue|svelte|astro|swift|m|mm|c|cc|cpp|h|hpp|cs|fs|php|lua|dart|ex|exs|erl|hs|ml|clj|zig|sh|sql|tf|ya?ml|json|toml|md|css|scss|html)$"
)
PRODUCT_JS = r"^[A-Z][a-z]+\.js$"
SUMMARY_PATH = r"(?:[\w@.-]+\/)*[\w@-]+\.[a-zA-Z]{1,6}\b"
SUMMARY_EXT = (
    r"\.(ts|tsx|js|jsx|mjs|cjs|py|java|kt|kts|go|rs|rb|php|cs|cpp|cc|c|h|hpp|swift|scala|dart|md|json|ya?ml|toml|sql|sh|css|scss|html|vue|svelte|gradle|xml|properties|lock)$"
)
TEST_PATH = r"(^|/)(test|tests|__tests__|spec)/|\.(test|spec)\.|_test\."
# Words in capitals that are no code names.
PLAIN_NAMES = "README TODO JSON HTTP HTTPS API URL SQL HTML CSS UUID GET POST PUT DELETE PATCH OK AI MCP CLI IDE".split()
# Kinds of symbols that hold members.
CLASS_LIKE = ("class", "interface", "enum", "record", "object", "struct", "type", "module")
# Kinds of symbols that can be called.
CALLABLE = ("function", "method", "constructor", "component", "hook", "macro")
# Points of a symbol search, by how a name matches.
SCORE_EXACT, SCORE_CASELESS, SCORE_SUFFIX, SCORE_PREFIX, SCORE_INSIDE, SCORE_QUALIFIED = 110, 100, 90, 70, 50, 40
SCORE_WORDS, SCORE_PER_WORD, WORD_OWN, WORD_OUTER, WORD_PATH = 8, 27, 1.0, 0.6, 0.25
BONUS_TYPE, BONUS_EXPORTED, BONUS_USES, MALUS_TEST = 4, 2, 6, 5
# Languages with their family and file endings.
LANGUAGES = (
    ("java", "jvm", ".java"), ("kotlin", "jvm", ".kt .kts"), ("go", "go", ".go"), ("python", "python", ".py .pyi .pyw"), ("typescript", "js", ".ts .mts .cts"), ("tsx", "js", ".tsx"),
    ("javascript", "js", ".js .mjs .cjs"), ("jsx", "js", ".jsx"), ("vue", "js", ".vue"), ("svelte", "js", ".svelte"), ("astro", "js", ".astro"), ("rust", "rust", ".rs"), ("c", "c", ".c .h"),
    ("cpp", "c", ".cc .cpp .cxx .c++ .hpp .hh .hxx .ipp .inl .cu .cuh"), ("objc", "c", ".m .mm"), ("csharp", "dotnet", ".cs"), ("fsharp", "dotnet", ".fs .fsi .fsx"), ("swift", "swift", ".swift"),
    ("dart", "dart", ".dart"), ("scala", "jvm", ".scala .sc"), ("groovy", "jvm", ".groovy .gradle .gvy"), ("ruby", "ruby", ".rb .rake .gemspec .ru"), ("php", "php", ".php .phtml"), ("lua", "lua", ".lua"),
    ("perl", "perl", ".pl .pm"), ("r", "r", ".r .R"), ("julia", "julia", ".jl"), ("haskell", "haskell", ".hs"), ("ocaml", "ocaml", ".ml"), ("elixir", "beam", ".ex .exs"), ("erlang", "beam", ".erl .hrl"),
    ("elm", "elm", ".elm"), ("clojure", "clojure", ".clj .cljs .cljc"), ("zig", "zig", ".zig"), ("bash", "shell", ".sh .bash .zsh .ksh"), ("powershell", "powershell", ".ps1 .psm1"),
    ("solidity", "solidity", ".sol"), ("hcl", "hcl", ".tf .hcl"), ("sql", "sql", ".sql"),
)
LANGUAGE_FILES = {"Jenkinsfile": "groovy", "Rakefile": "ruby", "Gemfile": "ruby", "Guardfile": "ruby"}
# How names are found across files, by language; endings are tried for a path without one.
LANGUAGE_RULES = {
    "rust": "prefix pathpkg", "c": "paths global functions transitive", "cpp": "paths global functions transitive members parents", "objc": "paths global functions transitive members",
    "csharp": "prefix parents members", "fsharp": "prefix parents", "swift": "target members", "dart": "paths members", "ruby": "global members parents", "php": "prefix global functions", "lua": "",
    "perl": "global", "r": "paths global functions transitive", "julia": "members transitive", "haskell": "prefix top", "ocaml": "prefix capital", "elixir": "global members", "erlang": "prefix global",
    "elm": "prefix", "clojure": "prefix hyphens top", "zig": "paths", "bash": "paths global transitive", "powershell": "paths global transitive", "solidity": "paths members", "hcl": "dir dirmodules",
    "sql": "global functions schemas",
}
RULE_ENDINGS = {
    "c": ".h .hpp .hh .hxx .inl .ipp", "cpp": ".h .hpp .hh .hxx .inl .ipp", "objc": ".h .hpp .hh .hxx .inl .ipp", "dart": ".dart", "ruby": ".rb", "lua": ".lua", "r": ".R .r", "julia": ".jl",
    "zig": ".zig", "bash": ".sh .bash", "powershell": ".ps1 .psm1", "solidity": ".sol",
}
JS_ENDINGS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts", ".d.ts")
INDEX_STEMS = ("init", "mod", "index", "__init__", "lib", "main")
# Guessed prices and token profiles by which models are ranked.
PRICE_GUESS = {("usd", "small"): (0.3, 1.5), ("usd", "medium"): (2.0, 10.0), ("usd", "large"): (10.0, 50.0), ("relative", "small"): (0.35, 0.35), ("relative", "medium"): (1.2, 1.2), ("relative", "large"): (2.5, 2.5)}
PROMPT_TOKENS, ANSWER_TOKENS, DEFAULT_EFFORT = 3000, 600, 2500
EFFORT_TOKENS = {"none": 0, "minimal": 150, "low": 800, "medium": 2500, "high": 7000, "xhigh": 15000, "max": 30000, "ultra": 60000}
OVERHEAD_TOKENS = {"codex": 7000, "claude": 6000, "copilot": 10000, "cursor": 8000, "kiro": 6000, "fake": 0}
LARGE_HINT = r"(?i)\b(opus|fable|astra|ultra|frontier|most demanding|premium|maximum)\b"
SMALL_HINT = r"(?i)\b(haiku|mini|nano|flash|lite|luna|small|tiny|micro|instant|spark|swift|air|affordable|efficient|lightweight|cheap|economy|easier tasks|efficiency)\b"
EXCLUDED_MODEL = r"(?i)(embed|embedding|image|audio|speech|tts|transcri|realtime|moderation|auto-review|cybersecurity|\bsecurity\b|computer-use)"
# Thresholds, bonuses and limits of retrieval, selection and status.
PROMPT_MIN_SCORE, PROMPT_LIMIT, TOPIC_BONUS, TOPIC_CAP, PATH_BONUS, CODE_BONUS = 0.12, 8, 0.15, 0.45, 0.5, 0.35
NEIGHBOUR_LIMIT, NEIGHBOUR_MIN, NEIGHBOUR_PATH_BONUS, SAME_RULE_SCORE = 6, 0.15, 0.2, 0.75
OVERLAP_MIN, OVERLAP_STRONG, OVERLAP_PER_RULE, OVERLAP_TOP = 0.6, 1.0, 3, 10
AUTHORITY = {"human-edit": 5, "user-instruction": 4, "user-correction": 4, "pr-review": 3, "agent-proposal": 2, "code-derived": 1}
STREAK_NOTICE, SILENCE_DAYS, SILENCE_COMMITS, QUALITY_STRIKES = 3, 14, 5, 2
CASE_QUIET_HOURS, CASE_RETENTION_DAYS, FIRST_SCAN_DAYS, OPEN_TURN_HOURS = 6, 90, 90, 12
ULID_DIGITS = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
SKIPPED_FOLDERS = (".git", "node_modules", "dist", "build", "out", "target", ".next", ".venv", "venv", "__pycache__", ".gradle", ".idea")
# fmt: on
# Names of standard libraries, which link nothing by themselves.
COMMON_NAMES = """
    get set add put remove delete push pop shift unshift map filter find findIndex forEach reduce some every includes indexOf join split slice splice concat keys values entries has clear size length
    toString valueOf equals hashCode compareTo then catch finally apply call bind log error warn info debug trace print println printf format sprintf append len cap close open read write flush next
    iterator stream collect toList of from subscribe pipe json text trim replace replaceAll match test exec sort reverse copy clone isEmpty isNotEmpty contains containsKey getOrDefault first last lower
    upper strip startswith endswith startsWith endsWith items update setdefault encode decode lock unlock wait notify sleep run Error New String Sprintf Println Printf Errorf Is As Unwrap invoke let also
    with takeIf use forEachIndexed mapNotNull
""".split()
# Fixed value: signs that do not show, those that turn the direction of writing among them (a class of a pattern).
INVISIBLE = "\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u2069\ufeff"
