"""Vocabularies and limits of the document domain. Order is meaning: the first pattern that matches wins."""

from __future__ import annotations

# Names, patterns and limits that results depend on.
DOMAINS = ("变电", "配电", "送电输电", "综合")
DOMAIN_KEYWORDS = {
    "变电": ["变电站", "变电", "变电所", "换流站", "GIS", "主变", "配电装置", "主接线", "电气一次", "电气二次", "继电保护", "综合自动化", "直流系统"],
    "配电": ["配电", "配网", "配电网", "10kV", "20kV", "箱变", "配电室", "充电站", "充电桩", "台区", "低压", "光伏", "分布式", "环网柜"],
    "送电输电": ["输电", "送电", "架空线路", "杆塔", "电缆线路", "电力电缆", "线路走廊", "导线", "地线", "OPGW", "绝缘子", "防振锤", "跨越", "耐张", "电磁环境", "电缆敷设", "架空电力线路"],
    "综合": ["省公司", "市公司", "发文", "管理制度", "费用标准", "定额", "信息价"],
}
STRONG_SUBSTATION = ["变电站", "GIS", "主变", "换流站", "变电所", "电气一次", "电气二次", "继电保护", "直流系统", "综合自动化"]
STRONG_LINE = ["架空线路", "杆塔", "导线", "地线", "OPGW", "绝缘子", "防振锤", "跨越", "耐张", "输电"]
PUBLISH_LEVELS = {
    "国标": [r"GB[/T]?\s*\d", "国标", "国家标准"],
    "行标": [r"DL[/T]?\s*\d", "DLT", "行标", "行业标准"],
    "企标": ["Q/GDW", "企标", "企业标准"],
    "国网公司": ["国家电网", "国网", "国家电网公司"],
    "省公司": ["闽电", "福建电力", "福建省电力", "福建省公司"],
    "地市公司": ["榕电", "榕能", "福州供电", "福州电力"],
}
QUERY_PUBLISH_LEVELS = {"国标": ["国标|GB|国家标准"], "行标": ["行标|DL|行业标准"], "省公司": ["省公司|福建电力|闽电"], "国网公司": ["国网公司|国家电网"]}
VOLTAGES = {
    "10kV": ["10kV", "10千伏", "10 kv", "~10kV"],
    "20kV": ["20kV", "20千伏"],
    "35kV": ["35kV", "35千伏"],
    "66kV": ["66kV", "66千伏"],
    "110kV": ["110kV", "110千伏"],
    "220kV": ["220kV", "220千伏"],
    "500kV": ["500kV", "500千伏"],
    "750kV+": ["750kV", "1000kV", "特高压"],
}
DISCIPLINES = {
    "电气一次": ["电气一次", "一次", "主接线", "配电装置", "GIS", "母线", "高压"],
    "电气二次": ["电气二次", "二次", "监控系统", "自动化", "测控", "信息模型"],
    "土建": ["土建", "建筑", "结构", "基础", "地基", "消防", "暖通", "给排水"],
    "线路": ["线路", "架空", "电缆", "杆塔", "导线", "送电", "输电"],
    "保护": ["保护", "继电", "继电保护", "调度", "安稳", "安自"],
    "通信": ["通信", "光缆", "光纤", "SDH", "OTN", "信息"],
}
EQUIPMENT = {
    "变压器": ["变压器", "主变", "配变", "站用变", "接地变"],
    "开关柜GIS": ["GIS", "开关柜", "环网柜", "充气柜", "中置柜"],
    "断路器": ["断路器", "SF6", "真空断路器"],
    "电缆导线": ["电缆", "导线", "架空线", "绝缘导线"],
    "继电保护": ["保护装置", "继电保护", "差动保护", "距离保护", "过流保护"],
    "互感器": ["互感器", "CT", "PT", "CVT", "电流互感器", "电压互感器"],
    "避雷器": ["避雷器", "SPD", "过电压保护"],
    "直流系统": ["直流", "蓄电池", "充电机", "UPS", "一体化电源"],
    "监控系统": ["监控", "SCADA", "远动", "RTU"],
    "新能源": ["光伏", "储能", "充电桩", "风电", "分布式电源"],
}
DOC_NUMBERS = [
    r"闽电\S*〔\d{4}〕\d+号",
    r"榕能\S*〔\d{4}〕\d+号",
    r"榕电\S*〔\d{4}〕\d+号",
    r"基建\S*〔\d{4}〕\d+号",
    r"国家电网企管〔\d{4}〕\d+号",
    r"国家电网基建〔\d{4}〕\d+号",
    r"运检\S*〔\d{4}〕\d+号",
    r"调继〔\d{4}〕\d+号",
    r"GB[/T]?\s*\d+[\.-]\d+",
    r"DL[/T]?\s*\d+[\.-]\d+",
    r"Q/GDW\s*\d+[\.-]\d+",
]
DRAWING_CODE = r"(\d+)-([A-Z]\d+-\d+)-([A-Z]\d+)-(\d+)"
DRAWING_DISCIPLINES = {"D01": "电气一次", "D02": "电气二次", "D03": "电气一次", "D04": "电气一次", "S01": "给排水/水工", "T01": "土建", "T02": "结构", "T03": "构支架基础", "N01": "暖通"}
FORMATS = {
    "drawing": [".dwg", ".dxf", ".dwl", ".dwl2"],
    "archive": [".zip", ".rar", ".7z"],
    "document": [".pdf", ".doc", ".docx", ".ceb", ".ofd", ".wps"],
    "spreadsheet": [".xls", ".xlsx", ".et"],
    "presentation": [".ppt", ".pptx"],
    "image": [".jpg", ".jpeg", ".png", ".tif", ".tiff", ".bmp", ".gif"],
    "text": [".chm", ".txt", ".md", ".html"],
}
DRAWING_PATHS = ["设计图纸", "国网通用设计", "福州主接线", "模块化建设", "cad"]
CLI_FORMATS = [".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ofd", ".txt", ".md"]
UPLOAD_FORMATS = [".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".txt", ".md", ".ofd", ".ceb", ".wps", ".jpg", ".jpeg", ".png"]
SYNONYMS = {
    "消防": ["防火", "灭火", "火灾报警", "消防给水", "消防设施", "消火栓"],
    "接地": ["接地装置", "接地电阻", "接地网", "接地系统", "保护接地", "工作接地"],
    "安全距离": ["净距", "间距", "安全净距", "带电距离", "最小距离"],
    "变压器": ["主变", "配变", "站用变", "变压器保护"],
    "电缆": ["电力电缆", "电缆线路", "电缆敷设", "电缆沟", "电缆隧道"],
    "保护": ["继电保护", "保护配置", "保护装置", "差动保护", "过流保护"],
    "设计深度": ["设计内容深度", "初步设计深度", "施工图深度", "可研深度"],
    "反措": ["反事故措施", "二十五项反措", "十八项反措", "防止事故"],
    "标准工艺": ["施工工艺", "工艺标准", "标准工艺手册"],
    "三维设计": ["三维数字化", "BIM", "三维建模", "数字化设计"],
}
COMPARISONS = ["(.+)和(.+)的?区别", "(.+)与(.+)的?区别", "(.+)和(.+)有什么不同", "对比(.+)和(.+)", "比较(.+)和(.+)"]
QUANTITIES = ["是多少", "多少米", "多大", "多长", "几米", "距离", "间距", "净距", "高度", "宽度", "不小于", "不大于", "不超过", "不应小于"]
DRAWING_WORDS = ["图纸", "方案图", "布置图", "接线图", "主接线", "平面图", "剖面图", "设计图", "CAD", "dwg"]
SEPARATORS = ["\n\n\n", "\n\n", "\n", "。", "；", "，", ". ", " ", ""]
NUMERALS = ["一", "二", "三", "四", "五", "六", "七", "八", "九", "十", "十一", "十二", "十三", "十四", "十五", "十六", "十七", "十八", "十九", "二十"]
STATUSES = ["pending", "processing", "completed", "failed", "deleted"]
#: Which status may follow which ("": a file that isn't known yet).
TRANSITIONS = {"": ("pending",), "pending": ("processing", "deleted"), "processing": ("completed", "failed"), "completed": ("pending", "deleted"), "failed": ("pending", "processing", "deleted"), "deleted": ("pending",)}
NATIONWIDE, STANDARDS = "全国", "标准规范"
CHUNK_CHARS, CHUNK_OVERLAP, FULL_CHARS, FORCE_CHARS, SINGLE_PAGES = 1536, 192, 1500, 50_000, 1
COARSE_K, FINE_K, RRF_K, DENSE_WEIGHT, SPARSE_WEIGHT = 50, 15, 60, 0.7, 0.3
CONTEXT_TOKENS, COMPRESS_AT, KEPT_MESSAGES = 32_768, 0.85, 6
FULL_DOCUMENT_CHARS = 10_000
NOT_REGISTERED, REGISTRATION_LOST, SOURCE_GONE = "文件未在注册表中找到", "文件注册信息丢失", "原始文件不存在，无法重建索引"
#: Least, most and default of the parameters of requests.
BOUNDS = {"search": (1, 50, 15), "ask": (5, 30, 15), "list": (1, 1000, 100)}
MEETING_FILE = r"会议材料之[^.]*\.(?:pdf|doc|docx)"
FOCUS = "【重要: 用户要查询的是文件 \"{name}\" 的内容, 请只基于该文件的 chunks 回答, 其他文件内容仅供背景参考, 不要混淆。】\n\n"
CUT_NOTICE = ("\n\n【注意：完整文档过长（", "字符），已截断至", "字符。此处仅展示前半部分，如需后续内容请具体提问。】")
ONLY_THIS = ("\n【⚠ 重要指令: 用户查询引用了文件 \"", "\"，请只基于上述完整文档内容回答，不要引用其他文件。以下其他文件片段仅供背景了解，回答中不要引用它们的内容。】\n")
#: Characters that text in binary files may have.
PLAUSIBLE = "一-鿿a-zA-Z0-9\\s.,;:!?()（）、。，；：！？'【】《》—…/%+\\-"

#: Words of the diagnosis of a question's best chunk.
DIAGNOSIS = {
    "coarse": "粗排第", "none": "无关键词", "missing": "检索缺失: 50条候选池中无chunk包含任何预期关键词", "pushed_out": "位, 精排后被挤出Top-", "after": "位, 精排后第", "outside": "位, 未进入Top-10",
    "raised": "位→精排后提升到第", "better": "位 (Reranker改善)", "then": "位→精排后第", "inside": "位 (已在Top-10内)", "place": "位", "worse": "位, 精排后反被挤掉 (Reranker退化)",
}
#: Patterns of file names in questions.
NUMERAL = "[一二三四五六七八九十\\d]+"
NAMED_FILE = r"(?iU)([\w一-鿿\-\s()（）]+\.(?:pdf|doc|docx|xls|xlsx|ppt|pptx|txt|ofd|ceb|dwg))"
BEFORE_FILE = r"(?U)([^\s，。,.]{2,30})\s*文件"
QUOTED = ("《([^》]+)》", '"([^"]+?)"')
QUESTION_NUMBERS = (r"(?U)[闽榕国]\S*〔\d{4}〕\d+号", r"(?U)[A-Z]{2,}[/T]?\s*\d+[\.\-]\d+", r"(?U)Q/GDW\s*\d+[\.\-]\d+")
#: What stands before the excerpts of other files.
SUPPLEMENTS = "【以下为检索到的其他相关文件片段，仅供参考背景，回答时请勿引用以下内容】"
