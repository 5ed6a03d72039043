from codeloom.cli import main

raise SystemExit(main())
