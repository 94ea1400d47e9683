"""Fixed values that results depend on.

FIXED VALUES: the keyword dictionaries and regular expressions below must
stay exactly as written, because token normalisation and every count
derived from it depend on them.
"""

# ---- FIXED VALUES: lexical profile (near-duplicate shingling) -------------
LEXICAL_CPP_KEYWORDS = (
    "auto", "break", "case", "char", "const", "continue", "default", "do",
    "double", "else", "enum", "extern", "float", "for", "goto", "if",
    "int", "long", "register", "return", "short", "signed", "sizeof", "static",
    "struct", "switch", "typedef", "union", "unsigned", "void", "volatile", "while",
    "class", "namespace", "template", "typename", "public", "private", "protected",
    "virtual", "override", "final", "explicit", "inline", "friend", "operator",
    "new", "delete", "this", "true", "false", "nullptr", "throw", "try", "catch",
)
LEXICAL_HLS_KEYWORDS = (
    "ap_int", "ap_uint", "ap_fixed", "ap_ufixed", "hls::stream", "stream",
    "pragma", "HLS", "PIPELINE", "UNROLL", "DATAFLOW", "INTERFACE",
    "ARRAY_PARTITION", "ARRAY_RESHAPE", "RESOURCE", "LATENCY",
)

# ---- FIXED VALUES: semantic profile (TF-IDF text) -------------------------
SEMANTIC_CPP_KEYWORDS = (
    "auto", "break", "case", "char", "const", "continue", "default", "do",
    "double", "else", "enum", "extern", "float", "for", "goto", "if",
    "int", "long", "register", "return", "short", "signed", "sizeof", "static",
    "struct", "switch", "typedef", "union", "unsigned", "void", "volatile", "while",
    "class", "private", "protected", "public", "friend", "inline", "template",
    "virtual", "bool", "true", "false", "namespace", "using", "try", "catch",
    "throw", "new", "delete", "this", "operator", "const_cast", "dynamic_cast",
    "reinterpret_cast", "static_cast", "typeid", "typename", "explicit", "mutable",
)
SEMANTIC_HLS_KEYWORDS = (
    "pragma", "hls", "pipeline", "unroll", "dataflow", "interface", "resource",
    "allocation", "array_partition", "array_map", "dependence", "inline",
    "loop_tripcount", "loop_merge", "loop_flatten", "occurrence", "protocol",
    "stable", "stream", "axis", "ap_int", "ap_uint", "ap_fixed", "ap_ufixed",
    "ap_shift_reg", "ap_fifo", "ap_memory", "ap_bus", "ap_none", "ap_vld",
    "ap_ack", "ap_hs", "ap_ovld", "bram", "uram", "lutram", "dsp", "ff",
)
SEMANTIC_ALGORITHM_KEYWORDS = (
    "sort", "search", "find", "merge", "split", "partition", "filter",
    "map", "reduce", "scan", "prefix", "suffix", "matrix", "vector",
    "array", "list", "tree", "graph", "hash", "heap", "stack", "queue",
    "dfs", "bfs", "dijkstra", "floyd", "kmp", "fft", "convolution",
)
# one-character punctuation dropped by the semantic profile
SEMANTIC_DROPPED_PUNCT = (".", ",", ";", "(", ")", "{", "}", "[", "]")

# ---- FIXED VALUES: regular expressions (portable Java regex / RE2) --------
LINE_COMMENT_RE = r"//[^\n]*"
BLOCK_COMMENT_RE = r"(?s)/\*.*?\*/"
DQUOTE_RE = r'"[^"]*"'
SQUOTE_RE = r"'[^']*'"
# a word is a run of letters, digits or '_' (the Unicode sense of \w);
# otherwise one non-blank symbol. Blanks are the Unicode white space set.
WORD_CLASS = r"\p{L}\p{N}_"
SPACE_CLASS = (r"\t\n\x{0B}\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}"
               r"\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
TOKEN_RE = "[" + WORD_CLASS + "]+|[^" + WORD_CLASS + SPACE_CLASS + "]"
DIGITS_RE = r"^\p{Nd}+$"
ALPHA_RE = r"^\p{L}+$"

# structural counters, counted per file as non-overlapping matches
STRUCTURAL_PATTERNS = (
    ("function_count", r"\w+\s*\([^)]*\)\s*\{"),
    ("loop_count", r"\b(for|while)\s*\("),
    ("include_count", r"#include"),
    ("pragma_count", r"#pragma"),
    ("class_count", r"\bclass\s+\w+"),
    ("template_count", r"\btemplate\s*<"),
    ("nested_loop_count", r"(?s)for\s*\([^}]*for\s*\("),
    ("conditional_count", r"\b(if|switch)\s*\("),
    ("pointer_usage", r"\*\w+|\w+\*|\->"),
    ("array_usage", r"\w+\[\w*\]"),
    ("hls_directive_count", r"(?i)#pragma\s+HLS"),
    ("ap_type_count", r"\bap_(int|uint|fixed|ufixed)"),
)
