"""What the executed plan of a DataFrame tells, once it has been collected."""


def nodes(plan):
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        yield from nodes(plan.executedPlan())
        return
    if name.endswith("QueryStageExec"):
        yield from nodes(plan.plan())
        return
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from nodes(children.apply(i))


def scans(df):
    """The metrics of each file scan, by name."""
    found = [n for n in nodes(df._jdf.queryExecution().executedPlan()) if n.getClass().getSimpleName() == "FileSourceScanExec"]
    names = ("numOutputRows", "numFiles", "numPartitions")
    return [{k: n.metrics().apply(k).value() for k in names if n.metrics().contains(k)} for n in found]


def text(df):
    return df._jdf.queryExecution().executedPlan().toString()
