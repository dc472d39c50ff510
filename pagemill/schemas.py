"""Schemas of stored records, in Spark DDL."""

LINK = "struct<url:string,text:string>"
IMAGE = "struct<src:string,alt:string,title:string>"

PAGE = (
    f"url string, title string, headings array<string>, paragraphs array<string>, links array<{LINK}>, "
    f"images array<{IMAGE}>, meta map<string,string>, content_length bigint, headings_count int, "
    "paragraphs_count int, links_count int, images_count int, scraped_at timestamp"
)
PAGE_STRUCT = "struct<" + ",".join(part.strip().replace(" ", ":", 1) for part in PAGE.split(", ")) + ">"

CRAWL_RESULT = (
    "base_url string, pages_scraped int, total_time double, depth int, max_pages int, "
    f"pages array<{PAGE_STRUCT}>, "
    "summary struct<total_headings:bigint,total_paragraphs:bigint,total_links:bigint,total_images:bigint,"
    "total_content_length:bigint>, scraped_at timestamp"
)
SUBMISSION = "url string, title string, headings array<string>, paragraphs array<string>"
PROCESSED_ITEM = (
    "struct<url:string,title:string,headings:array<string>,paragraphs:array<string>,meta:map<string,string>,"
    "processed_at:timestamp,content_length:bigint,headings_count:bigint,paragraphs_count:bigint>"
)
PROCESSED = f"id string, data array<{PROCESSED_ITEM}>, created_at timestamp, status string"
EXPORT = "id string, user_id string, format string, record_count bigint, file_path string, created_at timestamp, status string, error string"
LOG = (
    "timestamp timestamp, level string, logger string, message string, module string, function string, line int, "
    "method string, path string, duration double, status string, error string, client_ip string, user_agent string, "
    "exception string"
)
TASK_METRIC = "task_id string, timestamp timestamp, status string, duration double, response_time double, extra map<string,string>"
STATUS_EVENT = "id string, processing_status string, updated_at timestamp, error string"
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
