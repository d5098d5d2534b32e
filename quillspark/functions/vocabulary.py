"""Words with a fixed part in query understanding. Another language is another Vocabulary."""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed values, all lists below: results depend on every entry.
LOW_SIGNAL = (
    "什么 哪些 哪种 哪几种 为何 为什么 如何 怎么 有没有 介绍 一下 一下子 请问 的 了 吗 呢 各 各有 有 有什么 是 包括 机制 价值 作用 问题 优点 缺点 改进 思路 场景 概念 原理 基础 核心 关键 详细 常见 主要 相比 区别 不同 比较 对比 步骤 安装 配置 使用"
).split()
COVERAGE_LOW_SIGNAL = (
    "什么 哪些 哪种 哪几种 为何 为什么 如何 怎么 有没有 介绍 一下 一下子 请问 的 了 吗 呢 各 各有 有 有什么 是 包括 一下啊 一下呢 机制 价值 作用 问题 优点 缺点 改进 特点 思路 场景 概念 原理 基础 核心 关键 详细 常见 主要 相比 知识库 文档 笔记 资料 讲 里 里面 下 中 内"
).split()
COMMON_STOP = "什么 哪些 哪种 哪几种 哪个 知识库 笔记 分类 目录 专题 文档 资料 内容 文章 里 里面 中 内 下 的".split()
CONSTRAINT_STOP = [*COMMON_STOP, *"哪篇 有没有 有没 讲 介绍".split()]
LOOKUP_STOP = [*COMMON_STOP, *"查看 支持 对应 相关 可以 用于 表示 命令 参数 宏 文件类型 类型 信息 当前 常用 调试 问题 缺点 优点 价值 作用".split()]
EXISTENCE = "有没有 有无 是否有 哪篇 哪条 哪一篇".split()
COMPARISON = "相比 区别 不同 优缺点 优点 缺点 比较 对比".split()
PROCEDURE = "如何 怎么 步骤 安装 配置 使用 做法".split()
LOOKUP = "缩写 简称 哪个命令 什么命令 命令可以 哪些参数 什么参数 对应哪些宏 什么文件类型 文件类型".split()
LOOKUP_INTENT = [*LOOKUP, "缺点"]
METADATA = "分类 目录 专题 哪篇 里有没有 里面有没有 集合 笔记里".split()
ALIASES = [
    ["2pc", "两阶段提交", "两阶段提交协议"],
    ["3pc", "三阶段提交"],
    ["hlc", "hybrid logical clock", "混合逻辑时钟"],
    ["aoi", "area of interest", "感兴趣的区域"],
    ["gdb", "gnu debugger", "调试器"],
    ["subagent", "sub agent", "子代理"],
]


@dataclass(frozen=True)
class Vocabulary:
    low_signal: list[str] = field(default_factory=lambda: LOW_SIGNAL)
    coverage_low_signal: list[str] = field(default_factory=lambda: COVERAGE_LOW_SIGNAL)
    constraint_stop: list[str] = field(default_factory=lambda: CONSTRAINT_STOP)
    lookup_stop: list[str] = field(default_factory=lambda: LOOKUP_STOP)
    existence: list[str] = field(default_factory=lambda: EXISTENCE)
    comparison: list[str] = field(default_factory=lambda: COMPARISON)
    procedure: list[str] = field(default_factory=lambda: PROCEDURE)
    lookup: list[str] = field(default_factory=lambda: LOOKUP)
    lookup_intent: list[str] = field(default_factory=lambda: LOOKUP_INTENT)
    metadata: list[str] = field(default_factory=lambda: METADATA)
    lookup_info: str = r"查看[\x{4e00}-\x{9fff}A-Za-z0-9_/\-+\s]{0,12}信息"
    category: str = r"([\x{4e00}-\x{9fff}A-Za-z0-9_./+\-\s]{1,24})\s*分类(?:下|里|中|内)?"
    context: str = r"([\x{4e00}-\x{9fff}A-Za-z0-9_./+\-\s]{1,32})\s*(?:里|里面)"
    category_word: str = "分类"
