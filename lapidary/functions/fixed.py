"""Words, ids and texts that results depend on."""

#: Rules by category.
CATEGORIES = {
    "word": [1, 2, 3, 4, 5, 6, 7, 8, 24],
    "math": [9, 10, 11, 12, 13, 14, 15, 16, 17, 25],
    "spatial": [18, 19, 20, 21, 22, 23],
}
RULES = [str(i) for i in range(1, 26)]

#: Words of the first error and the category they stand for; the first that fits counts.
ERROR_CATEGORIES = [
    (("parse", "json"), "parse"),
    (("duplicate",), "duplicate"),
    (("structural", "invalid", "row", "column"), "structure"),
    (("crosscheck",), "crosscheck"),
    (("format",), "format"),
]

#: Words of the first error, root cause, stage, category, and whether fine-tuning may help; the first that fits counts.
ROOT_CAUSES = [
    (("parse", "json"), "unparseable output", "parsing", "prompt_issue", False),
    (("structural", "invalid"), "violated constraint", "structural_validation", "model_capability", True),
    (("crosscheck", "mismatch"), "disagreement", "crosscheck", "model_capability", True),
    (("duplicate",), "duplicate question", "dedup", "prompt_issue", False),
    (("format", "[[ "), "missing wrapper", "format_validation", "prompt_issue", False),
]

#: Advice by kind of failure.
ACTIONS = {
    "bad_answer_format": "strengthen JSON-only and [[...]] answer-wrapper constraints",
    "structural_invalid": "add rule-specific constraint checklist and tool verification reminder",
    "duplicate_of_eval": "increase diversity and anti-copy guidance",
    "duplicate_of_accepted": "increase diversity and anti-copy guidance",
    "crosscheck": "tighten solver/reviewer agreement criteria",
}

#: Weights of the run score.
SCORE_WEIGHTS = {"accept": 0.45, "structural": 0.25, "crosscheck": 0.15, "non_duplicate": 0.10, "latency": 0.05}

#: Checks by rule; every other rule only needs the wrapper.
LATIN_RULES = ["15", "16", "17", "25"]
GRID_RULES = ["11", "12", "13", "14", "18", "20", "21", "23", "24"]
WORD_RULES = ["2", "3", "4"]
MAPPING_RULES = ["5"]
EXPRESSION_RULES = ["10"]

#: Rules by the name of a domain.
DOMAINS = {
    "数学": CATEGORIES["math"], "字谜": CATEGORIES["word"], "空间": CATEGORIES["spatial"], "全部": list(range(1, 26)),
    "math": CATEGORIES["math"], "word": CATEGORIES["word"], "spatial": CATEGORIES["spatial"], "all": list(range(1, 26)),
}

#: Difficulty words and the bucket they ask for, in the order in which they are tried.
DIFFICULTY_WORDS = {
    "简单": "short", "容易": "short", "短": "short", "easy": "short", "中等": "medium", "普通": "medium", "一般": "medium", "mid": "medium",
    "困难": "long", "难": "long", "难一点": "long", "难一些": "long", "难些": "long", "复杂": "long", "烧脑": "long", "hard": "long",
}

#: Names of rules in a request.
RULE_NAMES = {
    "脑筋急转弯": "1", "word brain": "1", "brain teaser": "1", "词根": "2", "词缀": "2", "affix": "2", "root": "2", "连词": "3", "组词": "3",
    "connect word": "3", "字母重排": "4", "变位词": "4", "anagram": "4", "密码数学": "5", "加密数学": "5", "crypto": "5", "cryptarithm": "5",
    "单词阶梯": "6", "词梯": "6", "word ladder": "6", "逻辑": "7", "逻辑谜题": "7", "logic": "7", "单词搜索": "8", "找词": "8", "word search": "8",
    "填字": "24", "wordscape": "24", "数学路径": "9", "math path": "9", "24点": "10", "二十四点": "10", "24 point": "10", "24points": "10",
    "survo": "11", "kukurasu": "12", "库库拉苏": "12", "numbrix": "13", "数字接龙": "13", "数字墙": "14", "number wall": "14", "数独": "15",
    "sudoku": "15", "sudoko": "15", "计算数独": "16", "calcudoku": "16", "calcudoko": "16", "kenken": "16", "不等式": "17", "futoshiki": "17",
    "摩天大楼": "25", "摩天楼": "25", "skyscraper": "25", "skyscrapers": "25", "向量": "18", "矢量": "18", "vector": "18", "星战": "19", "星空": "19",
    "star battle": "19", "露营": "20", "帐篷": "20", "campsite": "20", "tents": "20", "扫雷": "21", "minesweeper": "21", "箭头迷宫": "22",
    "arrow maze": "22", "norinori": "23", "诺里诺里": "23",
}

#: Names of rules in feedback.
FEEDBACK_NAMES = {
    "anagram": "4", "变位词": "4", "字母重排": "4", "cryptarithm": "5", "密码数学": "5", "word ladder": "6", "单词阶梯": "6", "24点": "10",
    "24 points": "10", "sudoku": "15", "数独": "15", "calcudoku": "16", "kenken": "16", "futoshiki": "17", "不等式": "17", "skyscraper": "25",
    "skyscrapers": "25", "摩天大楼": "25",
}

#: Chinese numerals.
NUMERALS = {"零": 0, "一": 1, "两": 2, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10}

#: Words that tell what a request asks for, in the order in which they are tried.
INTENT_WORDS = {
    "LIST_RULES": ["list", "列出", "所有规则", "有哪些规则", "什么规则"],
    "HELP": ["帮助", "help", "怎么用", "能做什么", "功能"],
    "STATS": ["统计", "生成了多少", "进度"],
    "RECOMMEND": ["推荐", "下一步", "接下来", "适合", "该做什么", "recommend", "suggest", "next"],
    "VALIDATE": ["验证", "检查", "validate", "check data", "quality"],
    "EXPORT": ["导出", "保存", "export"],
}
INSPECT_WORDS = ["查看", "看看", "看", "显示", "inspect", "详情", "show"]
GENERATE_WORDS = [
    "生成", "出题", "出", "造题", "造", "做", "generate", "题目", "问题", "编", "给我", "给", "想要", "要", "来", "give", "create", "make", "add",
    "more", "another", "再", "加", "each", "继续", "类似", "刚才", "上次", "那种", "同样",
]
DOMAIN_REQUEST_WORDS = ["生成", "出题", "出", "造", "题目", "来点", "弄点", "给我", "来", "想做", "想要", "练", "挑战", "generate", "make", "create", "give"]
EACH_WORDS = ["each", "各", "每", "分别", "都"]
ALL_WORDS = ["都", "各", "each", "all"]
FOLLOW_WORDS = ["再来", "再出", "继续", "补", "加", "更多", "more", "another", "类似", "像刚才", "刚才那种", "上次那种", "同样", "same"]
LIKE_WORDS, UNLIKE_WORDS = ["类似", "像", "like"], ["不要", "不是", "不一样", "换个", "not"]
COMPOUND_WORDS = ["然后", "接着", "并且", "还有", "以及", "另外", "同时", "之后"]
GRID_WORDS = ["网格", "宫格", "grid"]

#: Words of a request, the rules they add, in this order.
DOMAIN_WORDS = [
    (GRID_WORDS, [11, 12, 13, 15, 16, 17, 25]),
    (["推理", "逻辑", "烧脑", "logic"], [7, 15, 17, 25]),
    (["类似数独", "像数独", "like sudoku"], [16, 17, 25]),
    (["类似24", "像24", "like 24"], [9, 11, 12]),
    *[([name], ids) for name, ids in DOMAINS.items()],
    (["文字", "单词", "词语", "语言"], CATEGORIES["word"]),
    (["计算", "数字", "算术"], CATEGORIES["math"]),
]
#: Words of a request and the rules they exclude.
EXCLUDE_WORDS = [
    (["not sudoku", "不要数独"], [15]),
    (["not 24", "不要24", "换个形式"], [10]),
    (["不要数学", "非数学", "不想数学", "not math"], CATEGORIES["math"]),
    (["不要字谜", "不要文字", "非文字", "not word"], CATEGORIES["word"]),
    (["不要空间", "非空间", "not spatial"], CATEGORIES["spatial"]),
]

#: Tools of a rule, of every rule, and of a role.
RULE_TOOLS = {
    "15": ["solve_sudoku", "validate_grid", "count_solutions"],
    "16": ["solve_latin_square", "validate_grid"],
    "17": ["solve_latin_square", "validate_grid", "evaluate_expression"],
    "25": ["solve_skyscraper", "solve_latin_square", "validate_grid"],
    "5": ["solve_cryptarithm", "evaluate_expression"],
    "10": ["solve_24points", "evaluate_expression"],
    "8": ["solve_word_search", "validate_grid"],
    "19": ["solve_star_battle", "validate_grid"],
    "21": ["solve_minesweeper", "validate_grid"],
}
DEFAULT_TOOLS = ["verify_answer", "check_duplicate", "measure_difficulty", "format_converter", "evaluate_expression"]
ROLE_TOOLS = {
    "generator": ["validate_grid", "check_duplicate", "measure_difficulty", "verify_answer", "evaluate_expression", "format_converter"],
    "solver": ["solve_sudoku", "solve_latin_square", "solve_skyscraper", "solve_24points", "solve_cryptarithm", "solve_word_search", "solve_minesweeper", "solve_star_battle", "evaluate_expression", "validate_grid", "count_solutions"],
    "reviewer": ["verify_answer", "validate_grid", "evaluate_expression", "count_solutions", "check_duplicate"],
}

#: Requests that probe the reading of intents: name, request, context, expected actions, rules and length.
PROBES = [
    ("followup_same_rule", "再来两道刚才那种，难一点", "Rule 10 (24 Points): 1/1 passed (first mode, 1 records)", ["GENERATE"], ["10"], "long"),
    ("domain_fuzzy_math_hard", "来点烧脑的数字网格题", "", ["GENERATE", "GENERATE", "GENERATE"], ["11", "12", "13"], "long"),
    ("similar_sudoku_not_same", "类似数独但不要数独本体，给我三个", "", ["GENERATE", "GENERATE", "GENERATE"], ["16", "17", "25"], ""),
    ("recommend_next", "根据我之前的偏好推荐下一步", "", ["RECOMMEND"], [], ""),
    ("multi_rule_each", "规则10和25都来一道", "", ["GENERATE", "GENERATE"], ["10", "25"], ""),
    ("word_not_math", "不要数学，来点文字类的题", "", ["GENERATE", "GENERATE", "GENERATE"], ["1", "2", "3"], ""),
    ("followup_all_recent_rules", "都再补一道", "Rule 10 (24 Points): 1/1 passed (first mode, 1 records)\nRule 25 (Skyscrapers): 1/1 passed (first mode, 1 records)", ["GENERATE", "GENERATE"], ["10", "25"], ""),
    ("analog_24_not_24", "像24点那种计算感，但换个形式，来两道", "", ["GENERATE", "GENERATE", "GENERATE"], ["9", "11", "12"], ""),
    ("negative_spatial_math", "不要空间类，想练计算推理", "", ["GENERATE", "GENERATE", "GENERATE"], ["7", "15", "17"], ""),
    ("english_fuzzy_grid", "give me 2 hard grid logic puzzles, not sudoku", "", ["GENERATE", "GENERATE", "GENERATE"], ["11", "12", "13"], "long"),
]
