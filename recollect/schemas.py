"""Explicit schemas of the tables and of the JSON inputs."""

MEMORY_ITEMS = (
    "id STRING, content STRING, memory_type STRING, importance DOUBLE, "
    "metadata MAP<STRING,STRING>, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ"
)
EPISODES = "episode_id STRING, session_id STRING, ts TIMESTAMP_NTZ, content STRING, context MAP<STRING,STRING>"
DOCUMENTS = "id STRING, title STRING, content STRING, metadata MAP<STRING,STRING>, created_at TIMESTAMP_NTZ"
CHUNKS = (
    "id STRING, doc_id STRING, chunk_index INT, content STRING, start_char INT, end_char INT, "
    "heading_path STRING"
)
STORE = {"memory_items": MEMORY_ITEMS, "episodes": EPISODES, "documents": DOCUMENTS, "chunks": CHUNKS}

VECTOR_SNAPSHOT = "dimension INT, vectors MAP<STRING,ARRAY<FLOAT>>"
GRAPH_SNAPSHOT = (
    "entities ARRAY<STRUCT<id:STRING,name:STRING,type:STRING>>, "
    "relations ARRAY<STRUCT<id:STRING,subjectId:STRING,predicate:STRING,objectId:STRING,memoryId:STRING>>, "
    "entityToMemories MAP<STRING,ARRAY<STRING>>, memoryToEntities MAP<STRING,ARRAY<STRING>>"
)

CALL_SAMPLE = (
    "id STRING, question ARRAY<ARRAY<STRUCT<role:STRING,content:STRING>>>, "
    "function ARRAY<STRING>, ground_truth STRING"
)
QA_SAMPLE = (
    "id STRING, task_id STRING, question STRING, Question STRING, answer STRING, `Final answer` STRING, "
    "level STRING, Level STRING, file_name STRING"
)
PLAN = (
    "id BIGINT, city STRING, start_date STRING, "
    "days ARRAY<STRUCT<date:STRING,day_index:INT,description:STRING,transportation:STRING,accommodation:STRING,"
    "hotel:STRUCT<name:STRING,address:STRING,price:DOUBLE>,"
    "attractions:ARRAY<STRUCT<name:STRING,address:STRING,duration:INT,price:DOUBLE>>,"
    "meals:ARRAY<STRUCT<type:STRING,name:STRING,cost:DOUBLE>>>>, "
    "weather ARRAY<STRUCT<date:STRING,day:STRING,night:STRING,temp:INT>>, "
    "budget STRUCT<attractions:DOUBLE,hotels:DOUBLE,meals:DOUBLE,transport:DOUBLE,total:DOUBLE>"
)
