"""Settings of a store: the reference names and shipped values, validated on construction."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields

#: Values that a size or an interval divides by or counts from, and so must be positive.
POSITIVE = ("NumberOfLevels", "MaxTables", "MaxBytesSSTables", "SegmentSize", "MaxHeight", "NumberOfSSTables", "IndexInterval", "SummaryInterval", "Capacity", "Rate", "M", "MaxSize", "NumberOfMemtables", "CacheMaxSize")
CHOICES = {"CompactBy": ("byte", "amount"), "CompactType": ("size_tiered", "leveled", "level"), "MemtableStructure": ("btree", "skiplist")}


@dataclass(frozen=True)
class Settings:
    NumberOfLevels: int = 5
    MaxTables: int = 4
    CompactBy: str = "byte"
    MaxBytesSSTables: int = 512
    CompactType: str = "size_tiered"
    SegmentSize: int = 512
    MaxHeight: int = 5
    NumberOfSSTables: int = 2
    IndexInterval: int = 5
    SummaryInterval: int = 5
    Capacity: int = 5
    Rate: int = 1
    M: int = 4
    MaxSize: int = 50
    MemtableStructure: str = "btree"
    NumberOfMemtables: int = 4
    CacheMaxSize: int = 3
    Compress: bool = False

    def __post_init__(self):
        for name in POSITIVE:
            value = getattr(self, name)
            if not isinstance(value, int) or isinstance(value, bool) or value < 1:
                raise ValueError(f"{name} must be a positive integer, not {value!r}")
        for name, allowed in CHOICES.items():
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}")
        if not isinstance(self.Compress, bool):
            raise ValueError("Compress must be true or false")

    @classmethod
    def from_json(cls, text: str) -> Settings:
        given, known = json.loads(text), {f.name for f in fields(cls)}
        if unknown := set(given) - known:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**given)

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2)
