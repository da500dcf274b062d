"""Fixed values that results depend on. The order within a list is free unless its comment says otherwise."""

#: Suffixes of documents and of style files.
DOCUMENT_SUFFIXES = (".tex", ".ltx")
STYLE_SUFFIXES = (".sty", ".cls")
#: Environments whose bodies are code; the last two are listings of prompts and examples.
VERBATIM = ("alltt", "filecontents", "filecontents*", "lstlisting", "minted", "Verbatim", "verbatim", "prompt", "case")
#: Commands that are kept whole, with the number of their arguments.
BOXES = {"fbox": 1, "framebox": 1, "makebox": 1, "colorbox": 2, "fcolorbox": 3, "parbox": 2, "tcbox": 1}
GLOSSARY = ("term", "gls", "Gls", "glspl", "Glspl", "acrshort", "Acrshort", "acrfull", "Acrfull", "acrshortpl", "Acrshortpl")
#: Of the library's own choice: what stands for a kept stretch, by its number.
PLACEHOLDER = r"\ParchmentKept"
#: Names of main files, and stems of files that hold macros.
MAIN_NAMES = ("main.tex", "paper.tex", "ms.tex", "article.tex")
MACRO_STEMS = ("macro", "macros", "command", "commands", "preamble")
#: Commands that define something, as counted for macro files, and as listed in guides.
DEFINERS = (
    "newcommand", "renewcommand", "providecommand", "DeclareRobustCommand", "def", "gdef", "edef", "xdef",
    "newenvironment", "renewenvironment", "newtcolorbox", "newtcblisting", "newtheorem",
)
LISTED_DEFINERS = ("newcommand", "renewcommand", "providecommand", "DeclareRobustCommand", "DeclareMathOperator", "def", "gdef", "edef", "xdef", "let")
OUTLINE = ("part", "chapter", "section", "subsection", "subsubsection")
TITLES = ("title", "icmltitle", "papertitle", "acltitle")
MATH_ENVIRONMENTS = ("equation", "align", "gather", "multline", "split", "cases")
#: Commands whose argument is an identifier.
IDENTIFIER_COMMANDS = (
    "label", "ref", "eqref", "cref", "Cref", "autoref", "cite", "citep", "citet", "citealp", "citealt", "citeauthor", "citeyear", "citeyearpar",
)
#: Marks, and conjunctions of English and Chinese, that may stand between two citations which are one list.
SEPARATORS = ",;，；、"
CONJUNCTIONS = ("and", "or", "和", "与", "及", "以及", "或", "或者")
#: Commands of fonts and text style, which a translation may drop or add.
TEXT_STYLE = (
    "bf", "em", "emph", "it", "md", "rm", "sc", "sf", "sl", "textbf", "textit", "textmd", "textnormal", "textrm", "textsc",
    "textsf", "textsl", "texttt", "textup", "tt", "underline", "up",
)
#: Of the library's own choice: names of the blocks of a request, which no answer may hold.
REQUEST_BLOCKS = ("TEXT_TO_TRANSLATE", "TEXT_BEFORE", "TEXT_AFTER", "GUIDE_OF_PAPER")
GRAPHICS_DRIVERS = (
    "dvipdf", "dvipdfm", "dvipdfmx", "dvips", "dvipsone", "dviwin", "emtex", "luatex", "pctex32", "pctexhp", "pctexps",
    "pdftex", "textures", "truetex", "vtex", "xetex",
)
#: Standard commands without arguments.
SWITCHES = (
    "bfseries", "centering", "footnotesize", "huge", "Huge", "itshape", "large", "Large", "LARGE", "mdseries", "noindent",
    "normalfont", "normalsize", "raggedleft", "raggedright", "rmfamily", "scshape", "scriptsize", "sffamily", "slshape",
    "small", "tiny", "ttfamily", "upshape",
)
NUMERIC_STYLES = ("plain", "unsrt", "abbrv", "ieeetr", "IEEEtran")
#: Characters of Chinese text, as in a character class.
CJK = r"\u3400-\u9fff"
#: Terms with a fixed translation, and terms that stay in English; of two that begin at one place the earlier counts.
PREFERRED_TRANSLATIONS = (("mechanistic interpretability", "机制可解释性"), ("representation", "表示，表征"))
PRESERVED_TERMS = (
    "token", "scaling law", "prompt", "in-context learning", "zero-shot", "few-shot", "chain-of-thought", "RLHF", "DPO",
    "KV cache", "RAG", "LoRA", "QLoRA", "AI safety", "alignment tax", "specification gaming", "reward hacking",
    "goal misgeneralization", "sandbagging", "scheming", "power-seeking", "sycophancy", "jailbreak", "prompt injection",
    "red teaming", "safety eval", "capability eval", "out-of-distribution", "OOD", "constitutional AI", "model autonomy",
    "scalable oversight", "alignment faking", "corrigibility", "eliciting latent knowledge", "ELK", "Transformer", "agent", "agentic",
)
#: Sizes: characters of a chunk (soft), of context on each side, entries of a history.
CHUNK_CHARS, CONTEXT_CHARS, HISTORY = 2048, 250, 200
