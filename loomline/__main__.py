"""python -m loomline
  list                                        names of all queries
  sql QUERY                                   the SQL that a query is compared with
  run QUERY FOLDER [OUTPUT]                   run a query now
  submit QUERY FOLDER [OPTION...]             submit a job, to be run by `work`; prints its id
  status ID | cancel ID | jobs                state of a job, cancel it if it runs, state of all
  work                                        run all pending jobs
Options: --tenant ID, --max-memory MB, --idempotency-key KEY, --output PATH; --store PATH for all job commands."""

from __future__ import annotations

import argparse
import os
import sys

from loomline import catalog
from loomline.errors import JobError
from loomline.lifecycle import Control, JobConfig, JobFolder


def _arguments(args: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(usage=__doc__, add_help=False, exit_on_error=False)
    p.add_argument("command")
    p.add_argument("rest", nargs="*")
    p.add_argument("--store", default=os.environ.get("LOOMLINE_JOBS", ".loomline-jobs"))
    p.add_argument("--tenant")
    p.add_argument("--max-memory", type=int, default=512)
    p.add_argument("--idempotency-key")
    p.add_argument("--output")
    return p.parse_args(args)


def _run(control: Control, name: str, folder: str, config: JobConfig) -> str:
    job = control.submit([(name, lambda df: df)], config)
    control.run(job, catalog.QUERIES[name](control.spark, folder)).show(truncate=False)
    return job


def _work(jobs: JobFolder) -> None:
    from loomline.session import session

    pending = [j for j in jobs.all() if j["status"] == "pending"]
    control = Control(session()) if pending else None
    for job in pending:
        jobs.update(job["graph_id"], status="running")
        try:
            own = _run(control, job["query"], job["folder"], JobConfig.from_json(job["config"]).with_config(idempotency_key=None))
            done = {"status": "completed", "stages_completed": list(control.job(own).rows)}
        except Exception as e:  # noqa: BLE001
            done = {"status": f"failed: {str(e).splitlines()[0][:200]}"}
        if jobs.get(job["graph_id"])["status"] == "running":
            jobs.update(job["graph_id"], **done)


def main(args: list[str]) -> int:
    try:
        a = _arguments(args)
    except (argparse.ArgumentError, SystemExit):
        print(__doc__)
        return 2
    try:
        match [a.command, *a.rest]:
            case ["list"]:
                print("\n".join(sorted(catalog.QUERIES)))
            case ["sql", name] if name in catalog.ORACLES:
                print(catalog.ORACLES[name])
            case ["run", name, folder, *rest] if name in catalog.QUERIES and len(rest) < 2:
                from loomline.session import session

                control = Control(session())
                job = _run(control, name, folder, JobConfig(output_path=rest[0] if rest else a.output, max_execution_ms=None))
                print(control.status(job), control.job(job).rows)
            case ["submit", name, folder] if name in catalog.QUERIES:
                config = JobConfig(a.max_memory, a.output, a.tenant, a.idempotency_key, max_execution_ms=None)
                print(f"Graph submitted: {JobFolder(a.store).submit(name, folder, config)}")
            case ["status", graph_id]:
                job = JobFolder(a.store).get(graph_id)
                print(f"Graph ID: {job['graph_id']}\nStatus: {job['status']}")
                if job["stages_completed"]:
                    print(f"Completed stages: {job['stages_completed']}")
            case ["cancel", graph_id]:
                JobFolder(a.store).cancel(graph_id)
                print(f"Graph cancelled: {graph_id}")
            case ["jobs"]:
                for job in JobFolder(a.store).all():
                    print(job["graph_id"], job["status"], job["query"])
            case ["work"]:
                _work(JobFolder(a.store))
            case _:
                print(__doc__)
                return 2
    except JobError as e:
        print(e)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
