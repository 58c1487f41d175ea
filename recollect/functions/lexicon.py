"""The entity dictionary and the cues used to type entities and relations."""

# Known terms by type, in dictionary order.
TERMS = {
    "language": [
        "Python", "Java", "JavaScript", "TypeScript", "Go", "Golang", "Rust", "C", "C++", "C#", "Ruby", "PHP", "Swift",
        "Kotlin", "Scala", "R", "MATLAB", "Lua", "Haskell", "Clojure", "Erlang", "Elixir", "Dart", "Perl", "Julia",
        "Shell", "Bash", "SQL",
    ],
    "paradigm": ["面向对象", "OOP", "函数式", "过程式", "响应式", "声明式", "命令式"],
    "field": [
        "机器学习", "深度学习", "自然语言处理", "NLP", "计算机视觉", "CV", "数据科学", "人工智能", "Web开发", "前端开发",
        "后端开发", "嵌入式开发", "DevOps", "网络安全", "大数据", "云计算", "区块链", "RAG", "检索增强生成",
    ],
    "framework": [
        "Spring", "Spring Boot", "Django", "Flask", "FastAPI", "React", "Vue", "Angular", "TensorFlow", "PyTorch",
        "Keras", "Scikit-learn", "Pandas", "NumPy", "Node.js", "Express", "jQuery", "Bootstrap", "Hibernate", "MyBatis",
        "Maven", "Gradle",
    ],
    "database": [
        "MySQL", "PostgreSQL", "MongoDB", "Redis", "Oracle", "SQLite", "Elasticsearch", "Cassandra", "Neo4j", "Qdrant",
        "Milvus", "HBase",
    ],
    "tool": [
        "Docker", "Kubernetes", "K8s", "Git", "GitHub", "GitLab", "Jenkins", "Nginx", "Apache", "Tomcat", "Linux",
        "JVM", "JDK", "Vosk", "Whisper", "Tika", "LLM", "API", "REST", "GraphQL", "HTTP", "HTTPS", "JSON", "XML", "YAML",
        "CSS", "HTML",
    ],
    "concept": [
        "微服务", "单体架构", "编译器", "解释器", "向量数据库", "知识图谱", "语义搜索", "嵌入", "向量化", "分词", "哈希",
        "排序", "索引", "缓存", "降级", "高可用", "跨平台", "设计模式",
    ],
    "organization": [
        "Google", "Microsoft", "Apple", "Amazon", "Meta", "OpenAI", "Anthropic", "阿里巴巴", "腾讯", "字节跳动", "百度",
        "Apache", "Oracle", "Sun Microsystems",
    ],
    "person": [
        "Guido van Rossum", "Linus Torvalds", "James Gosling", "Brendan Eich", "Dennis Ritchie", "Bjarne Stroustrup",
        "Yann LeCun", "Geoffrey Hinton",
    ],
}

# Words near a capitalised name that give its type; the first hit wins.
NAME_CUES = [
    ("language", ["语言", "language", "编程"]),
    ("framework", ["框架", "framework", "库"]),
    ("database", ["数据库", "database", "db"]),
    ("organization", ["公司", "company", "inc", "组织"]),
    ("algorithm", ["算法", "algorithm", "模型"]),
]

# What follows a name where the pair is a kind-of relation, for the first and the second name.
IS_A_AFTER_FIRST = ["是", "是一种", "属于", " is a ", " is an ", "被看作", "被视为"]
IS_A_ANYWHERE = ["被称作", "被称为"]
IS_A_AFTER_SECOND = ["是", "是一种", " is a ", " is an "]

# Phrases near two names that give their relation; the first hit wins.
RELATION_CUES = [
    ("USES", [
        "使用", "基于", "采用", "利用", "借助", "依赖", " uses ", " using ", " with ", " adopts ", " powered by ",
        " built on ", " relies on ",
    ]),
    ("PART_OF", [
        "组成部分", "属于", "包含", "是……的一部分", " is part of ", " belongs to ", " contained in ", "由……组成", "纳入",
    ]),
    ("CREATES", [
        "创建", "开发", "发明", "设计", "构建", "推出", "发布", " creates ", " developed ", " built ", " invented ",
        " designed ", " launched ", " released ",
    ]),
    ("RUNS_ON", [
        "运行在", "部署在", "跑在", "执行于", " runs on ", " deployed on ", " hosted on ", " supported on ",
        " compatible with ",
    ]),
]


def dictionary() -> list[tuple[str, str, int]]:
    """(name, type, position); a term listed twice keeps its first position and takes its last type."""
    types: dict[str, str] = {}
    for kind, names in TERMS.items():
        for name in names:
            types[name] = kind
    return [(name, kind, i) for i, (name, kind) in enumerate(types.items())]


def needs_boundary(term: str) -> bool:
    """Short ASCII terms without a blank would hit inside longer words."""
    return len(term) <= 4 and all(0x20 < ord(c) < 0x80 for c in term)
