from .plans.project import main

raise SystemExit(main())
