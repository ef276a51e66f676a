"""The README workflow runs as written."""

import os
import re

from conftest import ROOT


def test_readme_workflow(spark):
    text = open(os.path.join(ROOT, "README.md")).read()
    code = re.search(r"## Workflow\n\n```python\n(.*?)```", text, re.S).group(1)
    code = code.replace("spark = build_session()", "")          # use the test session
    code = code.replace("range(3)", "range(2)").replace(".show()", ".collect()")
    env = {"spark": spark}
    exec(compile(code, "README-workflow", "exec"), env)
    assert env["run"].metrics_history().count() == 2
