"""Messages that code publishes and consumes, schedules, and what else starts work without a request."""

from __future__ import annotations

import re

from factloom.extract.code import Source
from factloom.extract.data import _symbol_of
from factloom.sources import catalog

EVENT = "kind string, name string, line int, symbol string, bus string, callbacks array<string>"
#: Names that only one kind of bus is used by; fixed values.
_NAMED_BUS = {"KafkaListener": "kafka", "KafkaHandler": "kafka", "KafkaConsumer": "kafka", "WriteMessages": "kafka", "ConsumePartition": "kafka", "RabbitListener": "rabbitmq", "basic_publish": "rabbitmq", "basic_consume": "rabbitmq", "convertAndSend": "rabbitmq", "SqsListener": "sqs", "QueueSubscribe": "nats"}
#: Calls that send or take messages for sure, even if no topic can be read.
_SENDS, _TAKES = {"basic_publish", "convertAndSend", "WriteMessages", "sendMessage", "SendMessage"}, {"basic_consume", "ConsumePartition", "QueueSubscribe", "KafkaListener", "RabbitListener", "SqsListener", "KafkaConsumer", "NewReader"}

#: Prefixes of client settings that look like topics; fixed values.
_SETTINGS = ("bootstrap.", "group.", "auto.", "enable.", "security.", "sasl.", "key.", "value.", "max.", "session.", "acks", "spring.", "java.", "org.", "com.", "io.", "www.", "localhost")
_TOPIC = re.compile(r"[a-z][\w-]*(?:[.\-_][\w-]+)+$|[a-z]+s$")
_BUS = re.compile(r"kafka|rabbit|amqp|pika|lapin|\bnats\b|sqs|pubsub|sarama|bullmq|celery", re.I)


def is_topic(text: str) -> bool:
    return bool(_TOPIC.match(text)) and not text.startswith(_SETTINGS) and not re.search(r"\.(?:ts|js|json|py|go|rs|java|sql|com|org|io|net)$|[/\s]", text)


def events(path: str, text: str) -> list[dict]:
    """publish and consume of topics, null where none can be read; emit of events within a process; schedule, listen
    and startup entry points. A listener is named by the type of event that it takes, if that can be read."""
    language = catalog.language_of(path)
    if not language:
        return []
    # Python's strings and comments are close enough to the others' for this line-wise reading
    src = Source(re.sub(r"(?m)#[^\n]*", lambda m: " " * len(m[0]), text) if language == "Python" else text, "TypeScript" if language == "Python" else language)
    holder, out = None, []
    known = {m[1]: m[2] for m in re.finditer(r"(?m)\b([A-Z][A-Z0-9_]+|\w*[tT]opic\w*)\s*(?::[^=\n]+)?=\s*[\"'`]([\w.-]+)[\"'`]", src.text)}

    def note(kind: str, name: str | None, at: int, by: str = "", callbacks: list[str] | None = None) -> None:
        nonlocal holder
        holder = holder or _symbol_of(path, text)
        row = {"kind": kind, "name": name, "line": src.line(at), "symbol": holder(src.line(at)), "bus": _NAMED_BUS.get(by), "callbacks": callbacks or []}
        if row not in out:
            out.append(row)

    def topics(at: int, end: int) -> list[str]:
        found = [said for a, said in src.literals if at <= a <= end and is_topic(said)]
        return found or [known[n] for n in re.findall(r"\b([A-Za-z_]\w*)\b", src.code[at:end]) if n in known and is_topic(known[n])]

    if _BUS.search(text):
        from factloom.sources.schemas import close

        for m in re.finditer(r"\.((?:send|produce|publish|emit|sendMessage|convertAndSend|basic_publish|WriteMessages|SendMessage|enqueue|add)\w*)\s*\(", src.code):
            found = topics(m.end(), close(src.code, m.end() - 1))[:1]
            for t in found or [None] * (m[1] in _SENDS):
                note("publish", t, m.start(), m[1])
        blind = []
        for m in re.finditer(r"\.(subscribe|consume|basic_consume|queue_subscribe|Subscribe|QueueSubscribe|ConsumePartition)\s*\(|@(KafkaListener|RabbitListener|SqsListener|Incoming|KafkaHandler)\s*\(|(KafkaConsumer|Consumer|NewReader)\s*\(", src.code):
            opened, by = src.code.index("(", m.start()), m[1] or m[2] or m[3]
            end = close(src.code, opened)
            found = topics(opened, end)[:1]
            names = re.findall(r"(?<![\w.])([A-Za-z_]\w*)(?![\w(=])", src.code[opened:end])
            for t in found:
                note("consume", t, m.start(), by, names)
            blind += [(m.start(), by, names)] * (not found and by in _TAKES)
        if not any(r["kind"] == "consume" for r in out):  # else the topic is named by another call of the file
            for at, by, names in blind:
                note("consume", None, at, by, names)
    for m in re.finditer(r"\.publishEvent\s*\(\s*new\s+(\w+)|\.publishEvent\s*\(\s*(\w+)\s*\(", src.code):
        note("emit", m[1] or m[2], m.start())
    for m in re.finditer(r"@Scheduled\s*\(([^)]*)\)|@Cron\s*\(|\bcron\.schedule\s*\(|\.AddFunc\s*\(|\bscheduler\.add_job\s*\(|@\w*\.?(?:periodic_task|scheduled_job)\s*\(|time\.NewTicker\s*\(|\bsetInterval\s*\(", src.code):
        opened = src.code.index("(", m.start())
        said = next((s for a, s in src.literals if opened < a < opened + 60), None) or src.text[opened + 1 : src.text.find(")", opened)].strip()[:60]
        note("schedule", said, m.start())
    for m in re.finditer(r"@(?:EventListener|TransactionalEventListener|OnEvent|PostConstruct|Startup)\b|@(?:shared_task|app\.task|celery\.task)\b|@app\.on_event\(\s*[\"']startup", src.code):
        started = re.search("PostConstruct|[sS]tartup", m[0])
        taken = None if started else re.match(r"[^;{}]*?\b(?:void|fun)\s+\w+\s*\(\s*(?:final\s+)?(?:\w+\s*:\s*(\w+)|(\w+)\s+\w+)", src.code[m.end() :])
        note("startup" if started else "listen", (taken[1] or taken[2]) if taken else re.sub(r"\W", "", m[0]), m.start())
    return out
