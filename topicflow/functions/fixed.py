"""Fixed values.

Everything in this module is data, not logic: the labels, patterns, formats and
limits below must be exactly these for results to be right, so they are written
out plainly and in their natural order.
"""

# ---------------------------------------------------------------------------
# The default topic.  A record is on topic when any of these is
# found in "title\nabstract", ignoring case.
# ---------------------------------------------------------------------------
DEFAULT_TOPIC_PATTERNS = (
    r"\bin[- ]context\b",
    r"\bICL\b",
    r"\bmany[- ]shot\b",
    r"\bfew[- ]shot\b",
)

# ---------------------------------------------------------------------------
# The built-in taxonomy, in its own numbering 1-9.
# (priority, key, label, description, patterns); a lower priority wins.
# ---------------------------------------------------------------------------
BUILTIN_TAXONOMY = (
    (
        4,
        "prompt_eng",
        "📚 Prompt工程与优化",
        "研究如何设计和优化prompt来提升ICL效果，包括：示例选择、示例排序、prompt模板设计、指令优化等。",
        (
            r"\bprompt (engineering|design|optimization|learning|tuning)\b",
            r"\bexample selection\b|\bdemonstration selection\b|\bexemplar selection\b",
            r"\bselect(ing)? (examples|demonstrations|exemplars)\b",
            r"\bprompt ordering\b|\border(ing)? demonstrations\b|\bpermutation\b",
            r"\bcompose(d)? demonstrations\b|\bstructure(d)? prompt\b",
            r"\bretrieve demonstrations\b|\bfew[- ]shot (example|prompt)\b",
            r"\btemplate\b.*\b(design|optimization)\b|\binstruction (following|tuning)\b",
        ),
    ),
    (
        3,
        "reasoning_cot",
        "🧠 推理与思维链",
        "研究利用ICL进行复杂推理的方法，包括：思维链(CoT)、多步推理、自洽性、思维树等推理增强技术。",
        (
            r"\bchain[- ]of[- ]thought\b|\bCoT\b|\bscratchpad\b",
            r"\bself[- ]consistency\b|\btree[- ]of[- ]thought\b|\bgraph[- ]of[- ]thought\b",
            r"\bmultistep\b|\bmulti[- ]step\b|\bmultiple step\b",
            r"\breason(er|ing)\b.*\b(trace|path|step|chain|process)\b",
            r"\bdeliberat(e|ion)\b|\bthought (generation|process)\b",
            r"\bmany[- ]shot\b|\bmany[- ]step\b",
            r"\bintermediate (reasoning|step|output)\b|\bstep[- ]by[- ]step\b",
            r"\bcomplex reasoning\b|\blogical reasoning\b|\bmathematical reasoning\b",
        ),
    ),
    (
        8,
        "mechanism_theory",
        "🔬 机理理解与可解释性",
        "研究ICL的工作原理和理论基础，包括：机制分析、理论证明、可解释性研究、注意力分析、诱导头、电路分析等。",
        (
            r"\btheor(y|etical)\b.*\b(ICL|in[- ]context)\b",
            r"\bmechanis\w*\b.*\b(ICL|in[- ]context)\b",
            r"\binduction head(s)?\b|\bcircuit(s)?\b.*\b(analysis|discover)\b",
            r"\binterpretab\w*|\bexplainab\w*|\bunderstanding\b.*\b(ICL|in[- ]context)\b",
            r"\bassociative memory\b|\bhopfield\b|\bmeta[- ]learn\w*",
            r"\bimplicit (learning|gradient)\b|\bin[- ]weights\b",
            r"\bprovab\w*|\bconvergence\b|\blearning dynamics\b",
            r"\battribution\b|\bprobe\b|\bdiagnostic\b.*\bICL\b",
        ),
    ),
    (
        9,
        "model_training",
        "🏗️ 模型训练与架构",
        "研究如何通过模型训练和架构设计来增强ICL能力，包括：预训练方法、架构变体、注意力机制、位置编码、模型缩放等。",
        (
            r"\bpretrain\w*\b|\bfine[- ]tun\w*\b|\btraining\b",
            r"\barchitecture\b|\bmodel design\b|\bneural architecture\b",
            r"\bstate space model\b|\bxLSTM\b|\bmamba\b|\bretention\b",
            r"\bsequence model(ing)?\b|\bmixture of experts\b|\bMoE\b",
            r"\btransformer (variant|architecture|model)\b",
            r"\battention (mechanism|variant|pattern|head)\b",
            r"\bposition(al)? (encoding|embedding|interpolation)\b",
            r"\blayer (normalization|norm)\b|\bactivation function\b",
            r"\bmodel (scaling|size|capacity|parameter)\b",
            r"\bbackbone\b|\bfoundation model\b|\blarge language model\b.*\barchitecture\b",
        ),
    ),
    (
        6,
        "efficiency",
        "⚡ 效率优化",
        "研究如何提升ICL的计算效率，包括：上下文压缩、KV缓存优化、高效注意力机制、长度外推等。",
        (
            r"\bcontext compression\b|\bprompt compression\b",
            r"\bcompress(ion|ing)?\b.*\b(ICL|context|prompt)\b",
            r"\bdistill(at|ation)\w*\b.*\b(ICL|context|in[- ]context)\b",
            r"\b(in[- ]context )?autoencoder\b|\bcontext distillation\b",
            r"\bkv cache\b|\bkey[- ]value cache\b|\bcache\b.*\boptimization\b",
            r"\bprefill\b|\bthroughput\b|\blatency\b.*\b(optimization|reduction)\b",
            r"\befficient (attention|inference)\b|\blinear attention\b|\bflash[- ]?attention\b",
            r"\blength generaliz\w*\b|\blength extrapolat\w*\b",
            r"\btrain short.*infer long\b|\blong[- ]short\b",
            r"\bcontext length\b.*\b(generaliz\w*|extrapolat\w*|extension)\b",
            r"\bpositional extrapolat\w*\b|\bRoPE\b.*\bscaling\b",
        ),
    ),
    (
        1,
        "evaluation",
        "📊 评测基准与数据集",
        "研究ICL的评测方法和基准数据集，包括：基准构建、评测方法、消融实验、诊断工具、综述等。",
        (
            r"\bbenchmark\b.*\b(ICL|in[- ]context|few[- ]shot)\b",
            r"\b(evaluation|testbed|dataset)\b.*\b(ICL|in[- ]context|few[- ]shot)\b",
            r"\bnew (benchmark|dataset|task)\b",
            r"\bmeasure\b|\bmetric\b.*\b(ICL|in[- ]context)\b",
            r"\bablation (study|experiment)\b|\bempirical (study|analysis)\b",
            r"\bsurvey\b|\bliterature review\b",
        ),
    ),
    (
        2,
        "application_agent",
        "🤖 应用：Agent与工具使用",
        "研究ICL在Agent和工具使用场景中的应用，包括：规划、工具调用、函数调用、动作序列、轨迹学习等。",
        (
            r"\bagent(s)?\b.*\b(ICL|in[- ]context|few[- ]shot)\b",
            r"\bplanning\b.*\b(agent|ICL|in[- ]context)\b",
            r"\btool (use|usage|calling|learning)\b",
            r"\bfunction calling\b|\bAPI (call|usage)\b",
            r"\baction (sequence|selection)\b|\btrajectory\b",
            r"\breasoning and acting\b|\bReAct\b",
            r"\baudited reasoning\b|\bemergent abilit\w*\b",
        ),
    ),
    (
        7,
        "reliability_safety",
        "🛡️ 可靠性与安全",
        "研究ICL的可靠性和安全性问题，包括：校准、不确定性估计、鲁棒性、隐私、遗忘、攻击防御、幻觉等。",
        (
            r"\bcalibrat\w*|\buncertaint\w*|\bconfidence (estimation|calibration)\b",
            r"\breliabilit\w*\b|\brobust\w*\b.*\b(ICL|in[- ]context)\b",
            r"\bselective prediction\b|\babstain\b|\breject option\b",
            r"\bunlearning\b|\bforget(ting)?\b|\bmachine unlearning\b",
            r"\bprivacy\b.*\b(ICL|in[- ]context)\b|\bdata leakage\b",
            r"\battack\b.*\b(ICL|prompt)\b|\bbackdoor\b|\badversarial\b",
            r"\bjailbreak\b|\bprompt injection\b",
            r"\bwatermark\b|\bsafety\b|\brefusal\b",
            r"\bhallucination\b|\bfaithful\w*\b",
        ),
    ),
    (
        5,
        "specific_methods",
        "🎯 特定技术方法",
        "特定的ICL技术方法，包括：kNN-ICL、非参数方法、从错误学习、原则归纳、自我修正、对比学习等。",
        (
            r"\bnearest neighbor\b|\b(k[- ]?nn|kNN)\b.*\b(ICL|in[- ]context)\b",
            r"\bnonparametric\b.*\b(ICL|learning)\b|\bprototype(s)?\b",
            r"\bcalibration[- ]free\b|\bembedding[- ]based inference\b",
            r"\bvector database\b|\bretrieval[- ]augmented\b",
            r"\bmistake(s)?\b.*\b(learning|correction)\b",
            r"\berror(s)?\b.*\b(analysis|learning|feedback)\b",
            r"\bcounterexample(s)?\b|\bfrom mistakes\b",
            r"\bprinciple learning\b|\brule induction\b",
            r"\bself[- ]correction\b|\bself[- ]refinement\b|\bself[- ]improvement\b",
            r"\bcontrastive\b.*\b(ICL|learning)\b|\bsymbol tuning\b",
        ),
    ),
)

# Keys and labels of records no category matches.
DEFAULT_KEY = "other"
BUILTIN_DEFAULT_LABEL = "🧺 其他/未归类"
CUSTOM_DEFAULT_LABEL = "其他/未归类"
DEFAULT_DESCRIPTION = "无法归入以上任何类别的论文"

# ---------------------------------------------------------------------------
# Chinese stems in a category label and the English keywords each
# one adds to that category.
# ---------------------------------------------------------------------------
LABEL_STEMS = (
    ("视觉", ("visual", "vision", "image")),
    ("语言", ("language", "linguistic", "text", "nlp")),
    ("融合", ("fusion", "integration", "multimodal")),
    ("检索", ("retrieval", "search", "matching")),
    ("跨模态", ("cross-modal", "multimodal")),
    ("生成", ("generation", "generative", "generate")),
    ("图像", ("image", "visual", "picture")),
    ("文本", ("text", "language", "textual")),
    ("推理", ("reasoning", "inference")),
    ("模型", ("model", "network")),
    ("训练", ("training", "learning")),
    ("优化", ("optimization", "efficient")),
    ("评测", ("evaluation", "benchmark", "assessment")),
    ("安全", ("safety", "secure", "robust")),
    ("应用", ("application", "applied")),
)

# Text formats of a compiled category and of a report.
CUSTOM_KEY_FORMAT = "custom_%d"
DESCRIPTION_PREFIX = "包含关键词："
LONG_TAIL_LABEL = "其他（长尾）"
BUILTIN_LONG_TAIL_LABEL = "🧺 其他（长尾）"
DEFAULT_TOPK = 12

# ---------------------------------------------------------------------------
# Where submissions are listed, in the order they are tried.
# ---------------------------------------------------------------------------
BASE_URLS = ("https://api2.openreview.net", "https://api.openreview.net")
INVITATION_FORMATS = (
    "{conf}.cc/{year}/Conference/-/Submission",
    "{conf}.cc/{year}/Conference/-/Blind_Submission",
    "{conf}.cc/{year}/Conference/-/Paper",
    "{conf}.cc/{year}/conference/-/submission",
    "{conf}.cc/{year}/conference/-/blind_submission",
    "{conf}.cc/{year}/conference/-/Blind_Submission",
)
STRATEGIES = ("venueid", "all")  # server-side filter first, then filter here
UNKNOWN_SUBMISSIONS = -1  # the server-side filter hides the total
PAGE_STEP = 1000
NOTE_LIST_KEYS = ("notes", "data", "results")
ERROR_LINES_KEPT = 12

# ---------------------------------------------------------------------------
# Scoring.
# ---------------------------------------------------------------------------
CONFIDENCE_THRESHOLD = 0.6
FALLBACK_CONFIDENCE = 0.5
MISSING_CONFIDENCE = 0.5
BATCH_SIZE = 10
RECLASSIFY_BATCH_SIZE = 5
RULE_REASON = "Rule-based classification"
MISSING_ANSWER_REASON = "No classification returned"
FAILURE_REASON_PREFIX = "API Error: "
PROMPT_HEAD = """你是一个专业的AI论文分类助手。请根据论文的标题和摘要，将其分类到最合适的类别中。

分类标准：
"""
PROMPT_PAPERS = """

待分类论文：
"""
PROMPT_TAIL = """

请以JSON格式返回分类结果，格式如下：
{
  "classifications": [
    {
      "id": "paper_id",
      "category_key": "category_key",
      "confidence": 0.0-1.0,
      "reasoning": "简短说明分类理由（1-2句话）"
    }
  ]
}

注意：
1. 如果无法确定分类（confidence < 0.6），请使用 category_key: "other"
2. 每篇论文只选择一个最合适的类别
3. confidence表示分类置信度（0-1之间）
"""
